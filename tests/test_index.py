"""A kept index: found again, rebuilt when a row changes, read by its words' folders, and never through the texts."""

import math
import shutil

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import index as I
from loomspark.operators import lexical as L
from loomspark.operators import scoring


def test_kept_index(spark, tmp_path):
    tokens, rows = T.latin_tokens(F.col("text")), [(i, f"word{i % 7} common rare{i} common") for i in range(40)] + [(None, "common"), (41, None), (42, "")]
    save = lambda r, n, to: spark.createDataFrame(r, "doc_id long, text string").repartition(n).write.mode("overwrite").parquet(f"{tmp_path}/{to}")
    read = lambda at: spark.read.parquet(f"{tmp_path}/{at}")
    save(rows, 3, "a")
    queries = spark.createDataFrame([(1, "word3 rare10"), (2, "common common"), (3, "nothing"), (None, "common")], "query_id long, text string")
    where = f"{tmp_path}/index"
    first = I.kept_index(read("a"), tokens, where)
    want = sorted(map(tuple, L.bm25(queries, read("a"), "doc_id", tokens, tokens, 5).collect()))
    assert first.built and first.n == 42 and sorted(map(tuple, first.search(queries, tokens, 5).collect())) == want
    # the files are known: the texts are gone, and the index still answers
    again = I.kept_index(read("a"), tokens, where)
    found = again.search(queries, tokens, 5)
    frame = read("a")
    files = [p.split("/")[-3:] for p in found.inputFiles()]
    assert not again.built and again.key == first.key and not any("/a/" in "/".join(p) for p in files)
    shutil.rmtree(f"{tmp_path}/a")
    assert sorted(map(tuple, found.collect())) == want
    # only folders of the words are read
    one = again.search(queries.where("query_id = 1"), tokens, 5)
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString() or "PartitionFilters: [bucket" in one._jdf.queryExecution().toString()
    del frame
    # the same rows in other files and another order
    save(rows[::-1], 5, "b")
    other = I.kept_index(read("b"), tokens, where)
    assert not other.built and other.key == first.key
    for changed in ([*rows[:-1], (42, "x")], rows[1:], [*rows, rows[0]], [(r[0] if r[0] != 3 else 43, r[1]) for r in rows]):
        save(changed, 2, "c")
        assert I.kept_index(read("c"), tokens, where).key != first.key
    assert I.kept_index(read("b"), tokens, where, version="2").built
    # rows that are no files
    assert not I.kept_index(spark.createDataFrame(rows, "doc_id long, text string"), tokens, where).built
    # an index that broke off is built again
    shutil.rmtree(f"{where}/{first.key}/stats")
    assert I.kept_index(read("b"), tokens, where).built


def test_empty_corpus(spark, tmp_path):
    docs, tokens = spark.createDataFrame([], "doc_id long, text string"), T.latin_tokens(F.col("text"))
    kept = I.kept_index(docs, tokens, f"{tmp_path}/index")
    assert kept.n == 0 and kept.search(spark.createDataFrame([(1, "a word")], "query_id long, text string"), tokens, 3).count() == 0


def test_postings_in_blocks(spark, tmp_path, monkeypatch):
    """Many blocks, ids that repeat, ties over blocks, and queries too many for a task; a row is a word's list in a block."""
    tokens, rows = T.latin_tokens(F.col("text")), [(i % 90, f"word{i % 7} common rare{i} common" + " more" * (i % 3)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "word3 rare10 more more"), (2, "common common")], "query_id long, text string")
    flat = docs.select("doc_id", tokens.alias("t")).withColumn("dl", F.size("t")).select("doc_id", "dl", F.explode("t").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    flat = flat.join(flat.groupBy("term").agg(F.count("*").alias("df")), "term").collect()
    n, mean = len(rows), sum(r.tf for r in flat) / len(rows)
    want = []
    for query, asked in ((1, {"word3": 1, "rare10": 1, "more": 2}), (2, {"common": 2})):
        score = {}
        for r in flat:
            if r.term in asked:
                score[r.doc_id] = score.get(r.doc_id, 0) + asked[r.term] * math.log1p((n - r.df + 0.5) / (r.df + 0.5)) * r.tf * 2.2 / (r.tf + 1.2 * (0.5 + 0.5 * r.dl / mean))
        best = sorted((-round(s, 6), d) for d, s in score.items())[:20]
        want += [(query, i + 1, d, -s) for i, (s, d) in enumerate(best)]
    for words, most in ((2_000_000, 200_000), (1, 200_000), (1, 0)):
        monkeypatch.setattr(I, "BLOCK_WORDS", words)
        monkeypatch.setattr(scoring, "QUERY_ROWS", most)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
        kept = I.kept_index(docs, tokens, f"{tmp_path}/{words}-{most}")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert [(q, r, d, pytest.approx(s, abs=2e-6)) for q, r, d, s in want] == sorted(map(tuple, kept.search(queries, tokens, 20).collect()))
        assert kept.postings.groupBy("term", "block").count().where("count > 1").isEmpty() and (kept.postings.select("block").distinct().count() > 4) == (words == 1)
