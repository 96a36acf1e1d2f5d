"""Lexical retrieval: postings, BM25, rank fusion, snippets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import count_of
from loomspark.operators import scoring
from loomspark.operators.scoring import Queries, collected, counted_words, document_frequencies, task_top
from loomspark.sources.tables import small

PLACES = 6


def postings(docs: DataFrame, doc_id: str, tokens: Column) -> DataFrame:
    """term, doc_id, tf, dl. dl is counted before exploding, so no second pass or join is needed for it."""
    cut = docs.select(F.col(doc_id).alias("doc_id"), tokens.alias("t")).withColumn("dl", F.size("t"))
    return cut.select("doc_id", "dl", F.explode("t").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")).select("term", "doc_id", "tf", "dl")


def corpus_stats(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row: n documents (with or without tokens) and their mean length."""
    return docs.select(F.size(tokens).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def top_ranked(scored: DataFrame, k: int, query: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """Adds rank (from 1): higher score first, ties by id; keeps k a query."""
    w = Window.partitionBy(query).orderBy(F.desc(score), item)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(queries: DataFrame, docs: DataFrame, doc_id: str, tokens: Column, query_tokens: Column, k: int, k1: float = 1.2, b: float = 0.5, boosts: DataFrame | None = None, boost: float = 6.0, settings: DataFrame | None = None) -> DataFrame:
    """queries: query_id and what query_tokens needs. A query's repeated words count as often as they stand.
    Only postings of the queries' words are kept, before they are counted. boosts: query_id, doc_id of
    documents that get ``boost``, even without a common word. settings: setting, k1, b for a sweep in one job."""
    asked = queries.where("query_id is not null").select("query_id", F.explode(query_tokens).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    cut = docs.select(F.col(doc_id).alias("doc_id"), tokens.alias("t")).where("doc_id is not null")
    pairs = None if boosts is None else boosts.where("query_id is not null and doc_id is not null").select("query_id", "doc_id").distinct()
    few = collected(asked)
    if few is not None and pairs is not None:  # queries without words count here, as a boost needs none
        more = [r[0] for r in pairs.select("query_id").distinct().limit(scoring.QUERY_ROWS + 1).collect()]
        few = few.with_ids(more) if len(more) <= scoring.QUERY_ROWS else None
    if few is not None:
        return _bm25_in_tasks(few, cut, k, k1, b, pairs, boost, settings)
    vocabulary = asked.select("term").distinct()
    cut = cut.withColumn("dl", F.size("t"))
    stats = cut.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    kept = cut.select("doc_id", "dl", F.explode("t").alias("term")).join(vocabulary, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    frequency = kept.groupBy("term").agg(F.count("*").alias("df"))
    rows = kept.join(asked.join(frequency, "term"), "term").join(F.broadcast(stats))
    first, second, keys = F.lit(k1), F.lit(b), ["query_id"]
    if settings is not None:
        rows, first, second, keys = rows.join(F.broadcast(settings)), F.col("k1"), F.col("b"), ["setting", "query_id"]
    weight = F.col("qtf") * idf(F.col("n"), F.col("df")) * F.col("tf") * (first + 1) / (F.col("tf") + first * (1 - second + second * F.col("dl") / F.col("avgdl")))
    scored = rows.groupBy(*keys, "doc_id").agg(F.sum(weight).alias("score"))
    if pairs is not None:
        pairs = pairs.join(cut.select("doc_id"), "doc_id", "left_semi")
        pairs = pairs if settings is None else pairs.join(F.broadcast(settings.select("setting")))
        scored = scored.unionByName(pairs.select(*keys, "doc_id", F.lit(float(boost)).alias("score"))).groupBy(*keys, "doc_id").agg(F.sum("score").alias("score"))
    scored = scored.withColumn("score", F.round("score", PLACES))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, "rank", "doc_id", "score")


def _bm25_in_tasks(few: Queries, cut: DataFrame, k: int, k1: float, b: float, pairs: DataFrame | None, boost: float, settings: DataFrame | None) -> DataFrame:
    """bm25 for a query set that each task may hold: one pass over the texts, whose counts are written, then scores."""
    grid = [(0, k1, b)] if settings is None else [tuple(r) for r in settings.select("setting", "k1", "b").orderBy("setting").collect()]
    cut = cut.withColumn("extra", F.lit(None).cast("array<bigint>"))
    if pairs is not None:
        cut = cut.drop("extra").join(pairs.groupBy("doc_id").agg(F.collect_set(F.col("query_id").cast("long")).alias("extra")), "doc_id", "left")
    counted = counted_words(cut, few.words)
    df, n, mean = document_frequencies(counted, few.words)
    weight = few.times * np.repeat(np.log1p((n - df + 0.5) / (df + 0.5)), np.diff(few.begin))

    def factor(setting, text, times, lengths, texts):
        _, first, second = grid[setting]
        return times * (first + 1) / (times + first * (1 - second + second * lengths[text] / max(mean, 1e-300)))

    found = task_top(counted, few, weight, factor, len(grid), k, float(boost))
    keys = ["query_id"]
    if settings is not None:
        keys = ["setting", "query_id"]
        numbers = F.array(*(F.lit(g[0]) for g in grid))
        found = found.withColumn("setting", F.element_at(numbers, F.col("setting") + 1))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, "rank", "doc_id", F.round("score", PLACES).alias("score"))


def substring_top(asked: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """asked: query_id, word, of letters a-z; docs: doc_id, text. The k texts with the most places where a
    query's words stand as substrings, not overlapping; ties go to the shorter text, then the id.
    A word lies within one run of letters, so each distinct run is searched once, by its substrings of the
    words' lengths, and the texts meet the words through their runs by equality."""
    sizes = [r[0] for r in asked.select(F.length("word")).distinct().collect()]
    runs = F.regexp_extract_all("text", F.lit("[a-z]{%d,}" % min(sizes, default=1)), F.lit(0))
    cut = docs.select("doc_id", F.length("text").alias("n"), F.explode(runs).alias("run"))

    def pieces(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("run") - size + 1)
        return F.when(F.length("run") >= size, F.transform(starts, lambda i: F.substring(F.col("run"), i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    words = small(asked.select("word").distinct())
    found = cut.select("run").distinct().select("run", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *map(pieces, sizes)))).alias("word")).join(words, "word").select("run", "word", count_of(F.col("run"), F.col("word")).alias("c"))
    weights = small(found.join(asked, "word").groupBy("run", "query_id").agg(F.sum("c").alias("c")))
    held = cut.join(small(found.select("run").distinct()), "run", "left_semi").groupBy("doc_id", "n", "run").agg(F.count("*").alias("tf"))
    scored = held.join(weights, "run").groupBy("query_id", "doc_id", "n").agg(F.sum(F.col("tf") * F.col("c")).alias("hits"))
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "n", "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "hits")


def rrf(rankings: list[DataFrame], k: int, constant: int = 30) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, doc_id, rank)."""
    stacked = rankings[0].select("query_id", "doc_id", "rank")
    for r in rankings[1:]:
        stacked = stacked.unionByName(r.select("query_id", "doc_id", "rank"))
    fused = stacked.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 8).alias("score"))
    return top_ranked(fused, k).select("query_id", "rank", "doc_id", "score")


def rerank(candidates: DataFrame, scorer: Column, k: int) -> DataFrame:
    """candidates: query_id, doc_id and what scorer reads. Any column or Arrow UDF will do as a scorer."""
    return top_ranked(candidates.withColumn("score", F.round(scorer, PLACES)), k).select("query_id", "rank", "doc_id", "score")


def overlap_scorer(query_tokens: Column, tokens: Column) -> Column:
    """Share of the query's distinct words that the text has; stands in where no model is at hand."""
    q = F.array_distinct(query_tokens)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens)) / F.size(q)).otherwise(0.0)


def first_seen(ranked: DataFrame, entity: str) -> DataFrame:
    """Ranking of chunks to ranking of entities: an entity stands where its first chunk stood."""
    best = ranked.groupBy("query_id", entity).agg(F.min("rank").alias("first"))
    w = Window.partitionBy("query_id").orderBy("first", entity)
    return best.withColumn("rank", F.row_number().over(w).cast("int")).drop("first")
