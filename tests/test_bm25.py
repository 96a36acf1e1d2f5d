"""BM25 on query sides the tables do not hold, along both of its ways."""

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import lexical as L
from loomspark.operators import scoring
from loomspark.operators import vector as V

DOCS = [(1, "red fox jumps"), (2, "red red dog"), (3, None), (4, "blue whale sings blue"), (None, "red fox"), (5, ""), (6, "fox fox fox den")]


def run(spark, queries, boosts=None, settings=None, k=3):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    given = None if boosts is None else spark.createDataFrame(boosts, "query_id long, doc_id long")
    grid = None if settings is None else spark.createDataFrame(settings, "setting int, k1 double, b double")
    tokens = T.latin_tokens(F.col("text"))
    found = L.bm25(asked, docs, "doc_id", tokens, tokens, k, boosts=given, settings=grid)
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("rows", [200_000, 0])
def test_query_sides(spark, monkeypatch, rows):
    monkeypatch.setattr(scoring, "QUERY_ROWS", rows)
    assert run(spark, []) == [] and run(spark, [(None, "red fox")]) == [] and run(spark, [(1, None), (2, "the")]) == []
    both = run(spark, [(7, "red fox fox"), (None, "blue"), (9, "whale")])
    assert [(q, r, d) for q, r, d, _ in both] == [(7, 1, 6), (7, 2, 1), (7, 3, 2), (9, 1, 4)]
    boosted = run(spark, [(7, "red"), (8, "zebra")], [(7, 5), (8, 2), (8, 2), (9, 4), (None, 1), (9, None), (3, 77)])
    assert [(q, r, d) for q, r, d, _ in boosted] == [(7, 1, 5), (7, 2, 2), (7, 3, 1), (8, 1, 2), (9, 1, 4)] and boosted[0][3] == 6.0
    swept = run(spark, [(7, "fox")], settings=[(0, 1.2, 0.5), (4, 2.0, 1.0)])
    assert [(s, q, r, d) for s, q, r, d, _ in swept] == [(0, 7, 1, 6), (0, 7, 2, 1), (4, 7, 1, 6), (4, 7, 2, 1)] and swept[0][4] != swept[2][4]


def test_more_boosted_queries_than_fit(spark, monkeypatch):
    """None is cut and none gets another's boost."""
    queries, boosts = [(10 * i, "red") for i in range(6)], [(10 * i + 5, 4) for i in range(6)]
    whole = run(spark, queries, boosts)
    monkeypatch.setattr(scoring, "QUERY_ROWS", 7)
    assert run(spark, queries, boosts) == whole and {(r[0], r[2]) for r in whole if r[3] == 6.0} == set(boosts)


def test_gram_cosine_sides(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    for rows in ([], [(None, "red fox")], [(1, "")]):
        V.gram_cosine(spark.createDataFrame(rows, "query_id long, text string"), docs, "text", 2).collect()
    found = V.gram_cosine(spark.createDataFrame([(None, "red fox"), (4, "red fox jumps")], "query_id long, text string"), docs, "text", 1).collect()
    assert [(r.query_id, r.doc_id, r.score) for r in found] == [(4, 1, 1.0)]


def test_tasks_hold_bounded_pairs(spark, monkeypatch):
    """Batches are cut where texts and queries share many words, with the same results; settings of Arrow are bounded."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j % (i % 7 + 1)}" for j in range(i % 11))) for i in range(90)], "doc_id long, text string").repartition(2)
    asked = spark.createDataFrame([(i, f"w{i % 5} w0 w{i}") for i in range(30)], "query_id long, text string")
    tokens = F.split("text", " ")
    want = sorted(tuple(r) for r in L.bm25(asked, docs, "doc_id", tokens, tokens, 4).collect())
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
    monkeypatch.setattr(scoring, "ENTRIES", 100)
    assert want and sorted(tuple(r) for r in L.bm25(asked, docs, "doc_id", tokens, tokens, 4).collect()) == want
