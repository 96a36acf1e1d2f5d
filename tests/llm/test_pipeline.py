"""The corpus pipeline: stages keep columns and rows' meaning; the packed windows hold what is left."""

import random

import corpus_pipeline
import pytest

from loomspark.llm import packing

from .conftest import words
from .test_text_ops import toxic_docs


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    docs, labels = toxic_docs(spark)
    more = spark.createDataFrame([(10000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    both = docs.unionByName(more).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    both.write.parquet(f"{where}/documents.parquet")
    labels.selectExpr("doc_id", "1 as quality", "toxic").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages(spark, folder, texts):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeats", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns, name
    left = {r.doc_id: r.text for r in docs.collect()}
    assert len(left) < before and not [i for i in left if i < 5000 and i % 5 == 0]
    assert 10007 in left and 10008 not in left and 10000 in left and 10003 in left
    assert left[10003] == "one"
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(left)
    assert packed.dtypes == packing.pack_documents(docs).dtypes


def test_rows_that_share_an_id(spark):
    """One text of a doc_id is a near copy of another document, the others are unique; some rows are repeated."""
    rnd = random.Random(8)
    texts = [words(rnd, 80) for _ in range(5)]
    rows = [(1, texts[0]), (5, texts[0] + " end"), (5, texts[1]), (5, texts[2]), (5, texts[2]), (6, texts[3]), (7, None), (7, None), (None, texts[4]), (None, texts[4])]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    want = [(1, texts[0]), (5, texts[1]), (5, texts[2]), (6, texts[3]), (7, None), (None, texts[4]), (None, texts[4])]
    assert sorted(left, key=repr) == sorted(want, key=repr)


def test_empty(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
