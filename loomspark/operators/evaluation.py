"""Measures of retrieval, judging, routing and faithfulness as DataFrame jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import answer_form, latin_tokens, let, sentences, words
from loomspark.sources import tables
from loomspark.sources.storage import stored
from loomspark.sources.tables import bounded_batches

CUTS = (1, 3, 5, 10)


def _run_keys(words_: pa.Array, n: int) -> np.ndarray:
    """A hash of the n words from each word on."""
    coded = words_.dictionary_encode()
    hashed = hash_array(np.array(coded.dictionary.to_pylist(), object)) if len(coded.dictionary) else np.zeros(0, np.uint64)
    own = hashed[coded.indices.to_numpy()]
    out = np.zeros(max(len(own) - n + 1, 0), np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + own[i : len(own) - n + 1 + i]
    return out


def _runs_like(docs: DataFrame, probes: list[str], n: int) -> DataFrame:
    """docs: doc_id, w (words). doc_id, probe: the runs of n words that have the hash of one of the probes, as strings."""
    keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_run_keys(pa.array(p.split(" ")), n) for p in probes)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends, flat = np.cumsum(pc.list_value_length(lists).to_numpy()), lists.flatten()
            found = np.flatnonzero(np.isin(_run_keys(flat, n), keys))
            text = np.searchsorted(ends, found, "right")
            found, text = found[found + n <= ends[text]], text[found + n <= ends[text]]
            runs = [" ".join(flat[i : i + n].to_pylist()) for i in found.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(runs, pa.string())], ["doc_id", "probe"])

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, probe string")


def probe_gold(items: DataFrame, item_id: str, docs: DataFrame, doc_id: str, words_in_probe: int = 8) -> DataFrame:
    """query_id, doc_id: documents that hold the first words of an item, in order. Both sides are runs of that many words
    and meet by equality; where the probes are few (BROADCAST_ROWS), a task passes on only runs with the hash of one."""
    from loomspark.operators.linking import word_grams

    w = words(F.col("text"))
    probes = items.select(F.col(item_id).alias("query_id"), F.array_join(F.slice(w, 1, words_in_probe), " ").alias("probe"), F.size(w).alias("n")).where(F.col("n") >= words_in_probe).drop("n")
    few = [r[0] for r in probes.select("probe").distinct().limit(tables.BROADCAST_ROWS + 1).collect()]
    if len(few) <= tables.BROADCAST_ROWS:
        grams = _runs_like(docs.select(F.col(doc_id).alias("doc_id"), w.alias("w")), few, words_in_probe)
    else:
        grams = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(word_grams(F.col("text"), words_in_probe))).alias("probe"))
    return grams.join(tables.small(probes), "probe").select("query_id", "doc_id").distinct()


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """One row a query with gold: recall, precision, hit and nDCG at each cut, and the reciprocal rank of the first hit."""
    ranked, gold = stored(ranked, "ranked"), stored(gold, "gold")  # each is read twice
    sizes = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    returned = ranked.groupBy("query_id").agg(F.count("*").alias("n_ranked"))
    hits = ranked.join(gold, ["query_id", "doc_id"]).select("query_id", "rank")
    gain = 1 / F.log2(F.col("rank") + 1.0)
    per = hits.groupBy("query_id").agg(
        *(F.count_if(F.col("rank") <= k).alias(f"_h{k}") for k in cuts), *(F.sum(F.when(F.col("rank") <= k, gain)).alias(f"_g{k}") for k in cuts), F.min("rank").alias("_first")
    )
    out = sizes.join(per, "query_id", "left").join(returned, "query_id", "left")
    columns = [F.col("query_id")]
    for k in cuts:
        h = F.coalesce(F.col(f"_h{k}"), F.lit(0))
        best = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_gold")).cast("int")), F.lit(0.0), lambda t, i: t + 1 / F.log2(i + 1.0))
        columns += [
            F.round(h / F.col("n_gold"), 4).alias(f"recall_{k}"),
            F.round(F.when(F.coalesce(F.col("n_ranked"), F.lit(0)) > 0, h / F.least(F.lit(k), F.col("n_ranked"))).otherwise(0.0), 4).alias(f"precision_{k}"),
            (h > 0).cast("int").alias(f"hit_{k}"),
            F.round(F.coalesce(F.col(f"_g{k}"), F.lit(0.0)) / best, 4).alias(f"ndcg_{k}"),
        ]
    columns.append(F.round(F.coalesce(1 / F.col("_first"), F.lit(0.0)), 4).alias("reciprocal_rank"))
    return out.select(*columns)


def mean_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("n_queries"), *(F.round(F.avg(c), 4).alias(c) for c in per_query.columns if c != "query_id"))


def _forms(answer: str, gold: str, distinct: bool = False) -> Column:
    """struct(p, golds): the forms of an answer and of its gold strings that are not empty, for judges to read once made."""
    golds = F.transform(F.col(gold), answer_form)
    return F.struct(answer_form(F.col(answer)).alias("p"), F.filter(F.array_distinct(golds) if distinct else golds, lambda g: g != "").alias("golds"))


def judge_set(df: DataFrame, answer: str, gold: str) -> Column:
    """F1 of the gold strings contained in an answer. Precision is recall, as wrong extras cannot be told
    from prose, less three tenths where the answer is over three times as long as the gold."""
    def judged(x: Column) -> Column:
        p, golds = x["p"], x["golds"]
        hits = F.size(F.filter(golds, lambda g: F.contains(p, g)))
        return F.struct(hits.alias("hits"), F.size(golds).alias("n"), (F.length(p) / F.greatest(F.aggregate(golds, F.lit(0), lambda t, g: t + F.length(g)), F.lit(1)) > 3).alias("long"))

    def f1(x: Column) -> Column:
        recall = x["hits"] / x["n"]
        precision = F.when(x["long"], recall * 0.7).otherwise(recall)
        return F.when((x["n"] == 0) | (x["hits"] == 0), 0.0).otherwise(F.round(2 * precision * recall / (precision + recall), 4))

    return let(let(_forms(answer, gold, distinct=True), judged), f1)


def judge_contains(df: DataFrame, answer: str, gold: str) -> Column:
    """Share of the gold fragments that the answer contains."""
    def share(x: Column) -> Column:
        p, golds = x["p"], x["golds"]
        return F.when((p == "") | (F.size(golds) == 0), 0.0).otherwise(F.round(F.size(F.filter(golds, lambda g: F.contains(p, g))) / F.size(golds), 4))

    return let(_forms(answer, gold), share)


def judge_exact(df: DataFrame, answer: str, gold: str) -> Column:
    """1 if the answer equals a gold string or contains one between word bounds."""
    def exact(x: Column) -> Column:
        p, golds = x["p"], x["golds"]
        return F.when((p != "") & F.exists(golds, lambda g: F.contains(F.concat(F.lit(" "), p, F.lit(" ")), F.concat(F.lit(" "), g, F.lit(" ")))), 1.0).otherwise(0.0)

    return let(_forms(answer, gold), exact)


def confusion(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    return df.groupBy(expected, predicted).agg(F.count("*").alias("n"))


def trace_coverage(answers: DataFrame, least: float = 0.6) -> DataFrame:
    """answers: query_id, answer, evidence. A sentence is supported if enough of its content words are in
    the evidence and one pair of neighbouring words is too. Per query: sentences, supported ones, their share."""
    said = answers.select("query_id", F.explode(sentences(F.col("answer"))).alias("s"), F.array_distinct(words(F.col("evidence"))).alias("known"), _pairs(words(F.col("evidence"))).alias("known_pairs"))
    content, pairs = latin_tokens(F.col("s")), _pairs(words(F.col("s")))
    hit = F.size(F.filter(content, lambda w: F.array_contains(F.col("known"), w)))
    ratio = F.when(F.size(content) > 0, hit / F.size(content)).otherwise(1.0)
    supported = (F.size(content) == 0) | ((ratio >= least) & ((F.size(content) < 2) | F.arrays_overlap(pairs, F.col("known_pairs"))))
    return said.groupBy("query_id").agg(F.count("*").alias("n_sentences"), F.count_if(supported).alias("supported"), F.round(F.avg(supported.cast("double")), 4).alias("share"))


def _pairs(w: Column) -> Column:
    none = F.array().cast("array<string>")
    return let(w, lambda x: F.when(F.size(x) > 1, F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda i: F.concat_ws(" ", F.element_at(x, i), F.element_at(x, i + 1)))).otherwise(none))


def interval_coverage(gold: DataFrame, found: DataFrame, owner: str) -> DataFrame:
    """Both: owner, low, high. The share of each gold interval that found intervals of its owner cover together; places
    that several cover count once, and an interval that none meets has 0, as has an empty one."""
    met = gold.select(owner, "low", "high").distinct().join(found.select(owner, F.col("low").alias("_l"), F.col("high").alias("_h")), owner, "left")
    clipped = met.withColumn("_l", F.greatest("low", "_l")).withColumn("_h", F.least("high", "_h"))
    before = Window.partitionBy(owner, "low", "high").orderBy("_l", "_h").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col("_h") - F.greatest("_l", F.max("_h").over(before)), F.lit(0))
    covered = clipped.withColumn("_new", new).groupBy(owner, "low", "high").agg(F.coalesce(F.sum("_new"), F.lit(0)).alias("_c"))
    size = F.col("high") - F.col("low")
    return covered.select(owner, "low", "high", F.when(size > 0, F.col("_c") / size).otherwise(0.0).alias("share"))


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds *_scaled: each column between its least (0) and greatest (1) value over the table; 0 if all are equal.
    The ends are one aggregated row, so no window gathers the table in one task."""
    ends = df.agg(*(F.min(c).alias(f"_lo_{c}") for c in columns), *(F.max(c).alias(f"_hi_{c}") for c in columns))
    both = df.join(F.broadcast(ends))
    for c in columns:
        width = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        both = both.withColumn(f"{c}_scaled", F.round(F.when(width > 0, (F.col(c) - F.col(f"_lo_{c}")) / width).otherwise(0.0), 4))
    return both.drop(*(f"{p}{c}" for c in columns for p in ("_lo_", "_hi_")))
