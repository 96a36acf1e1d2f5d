"""Vector operators as expressions over arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import char_grams, let, padded
from loomspark.operators.lexical import top_ranked
from loomspark.operators.scoring import collected, task_top
from loomspark.sources.tables import bounded_batches, small

#: Vectors to a block of ``cosine_top``; a block has at most twice as many. Groups of blocks at most.
BLOCK, GROUPS = 4096, 48
WEIGHTS = {0: 1.2, 1: 1.2, 2: 1.0, 3: 1.0, 4: 1.0, 5: 0.6}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v by its length; a vector of noughts stays."""
    return let(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _unit_blocks(vectors: DataFrame, buckets: int) -> DataFrame:
    """bucket, ids, width, body: unit vectors packed together, shorter ones padded with noughts."""

    def run(batches):
        now, ids, rows = None, [], []

        def flush():
            body = np.zeros((len(rows), max(map(len, rows))))
            for i, r in enumerate(rows):
                body[i, : len(r)] = r
            length = np.sqrt((body * body).sum(axis=1, keepdims=True))
            body /= np.where(length == 0, 1, length)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([body.shape[1]], pa.int32()), pa.array([body.tobytes()], pa.binary())], ["bucket", "ids", "width", "body"])

        for batch in batches:
            for bucket, vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if ids and (bucket != now or len(ids) >= 2 * BLOCK):
                    yield flush()
                    ids, rows = [], []
                now = bucket
                ids.append(vec_id)
                rows.append(v.values.to_numpy())
        if ids:
            yield flush()

    dealt = vectors.withColumn("bucket", F.pmod(F.xxhash64("vec_id"), F.lit(buckets)).cast("int")).select("bucket", "vec_id", "v")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "vec_id").mapInArrow(run, "bucket int, ids binary, width int, body binary")


def _merge(q: np.ndarray, best: tuple[np.ndarray, np.ndarray], x: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Puts the block's best of each query into best (scores, ids)."""
    common = min(q.shape[1], x.shape[1])
    for low in range(0, len(q), 512):
        s, i = (b[low : low + 512] for b in best)
        scores = np.round(q[low : low + 512, :common] @ x[:, :common].T, 6) + 0.0
        bar = np.maximum(s[:, -1], np.partition(scores, -k, axis=1)[:, -k] if k < len(ids) else -np.inf)
        row, at = np.nonzero(scores >= bar[:, None])
        row, score, item = np.append(row, np.repeat(np.arange(len(s)), k)), np.append(scores[row, at], s), np.append(ids[at], i)
        order = np.lexsort((item, -score, row))
        kept = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < k]
        s[:], i[:] = score[kept].reshape(-1, k), item[kept].reshape(-1, k)


def _blocks_top(asked: DataFrame, held: DataFrame, places: int, k: int) -> DataFrame:
    """asked, held: place and a block of vectors. query_id, vec_id, score: for each vector asked at a place the k best of
    those held there. A task keeps the blocks that ask, and the blocks held pass by."""

    def run(batches):
        now, asking = None, []

        def flush():
            for q_ids, _, (s, i) in asking:
                row, at = np.nonzero(s > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(i[row, at]), pa.array(s[row, at])], ["query_id", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                place, second, ids, width, body = (batch.column(c)[r].as_py() for c in range(5))
                if place != now:
                    yield from flush()
                    now, asking = place, []
                ids = np.frombuffer(ids, np.int64)
                x = np.frombuffer(body).reshape(len(ids), width)
                if not second:
                    asking.append((ids, x, (np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64))))
                else:
                    for _, q, best in asking:
                        _merge(q, best, x, ids, k)
        yield from flush()

    columns = ("ids", "width", "body")
    dealt = asked.select("place", F.lit(0).alias("met"), *columns).unionByName(held.select("place", F.lit(1).alias("met"), *columns))
    return dealt.repartition(4 * places, "place").sortWithinPartitions("place", "met").mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """queries: query_id, q; vectors: vec_id, v. The k nearest vectors of each query, by matrix products of blocks. The
    queries, in parts of at most 2 * ``BLOCK``, are written once for each of at most ``GROUPS`` groups of vectors, a vector once for
    each part of the queries. Vectors that are null or have components that are null or not finite take no part."""
    bounded_batches(vectors.sparkSession)
    asked, usable = _usable(queries.select(F.col("query_id").alias("vec_id"), F.col("q").alias("v"))), _usable(vectors)
    parts, buckets = max(1, -(-asked.count() // BLOCK)), max(1, -(-usable.count() // BLOCK))
    groups = min(buckets, GROUPS)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = _unit_blocks(asked, parts).withColumn("group", each(groups)).withColumn("place", F.col("bucket") * groups + F.col("group"))
    x = _unit_blocks(usable, buckets).withColumn("part", each(parts)).withColumn("place", F.col("part") * groups + F.col("bucket") % groups)
    found = _blocks_top(q, x, parts * groups, k)
    return top_ranked(found, k, item="vec_id").select("query_id", "rank", "vec_id", "score")


def cosine_top_all(vectors: DataFrame, k: int) -> DataFrame:
    """vectors: vec_id, v. The k nearest vectors (itself among them) of every vector: ``cosine_top`` where all ask; rows
    are replicated by blocks, never by rows."""
    usable = _usable(vectors)
    buckets = max(1, -(-usable.count() // BLOCK))
    held = _unit_blocks(usable, buckets)
    met = held.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("place"), "ids", "width", "body")
    found = _blocks_top(held.withColumn("place", F.col("bucket")), met, buckets, k)
    return top_ranked(found, k, item="vec_id").select("query_id", "rank", "vec_id", "score")


def gram_cosine(queries: DataFrame, docs: DataFrame, text: str, k: int, n: int = 3) -> DataFrame:
    """queries: query_id, docs: doc_id, both with the column text. Cosine of n-gram counts through the grams both sides have; a query set that a task may hold is scored where
    the texts lie, a larger one by a join on grams."""
    queries, docs = queries.where("query_id is not null"), docs.where("doc_id is not null")
    q = queries.select("query_id", F.explode(char_grams(F.col(text), n)).alias("g")).groupBy("query_id", "g").agg(F.count("*").alias("x"))
    few = collected(q.select("query_id", F.col("g").alias("term"), F.col("x").alias("qtf")))
    if few is not None and n <= 3:
        lengths = np.sqrt(np.bincount(few.query, few.times * few.times, len(few.ids)))

        def factor(setting, text, times, _, texts):
            return times / np.sqrt(np.bincount(text, times * times, texts))[text]

        rows = docs.select("doc_id", padded(F.col(text)).alias("t"), F.lit(None).cast("array<bigint>").alias("extra"))
        found = task_top(rows, few, few.times / lengths[few.query], factor, 1, k, grams=n)
        return top_ranked(found.withColumn("score", F.round("score", 6)), k).select("query_id", "rank", "doc_id", "score")
    q_norm = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("qn"))
    d = docs.select("doc_id", F.explode(char_grams(F.col(text), n)).alias("g")).groupBy("doc_id", "g").agg(F.count("*").alias("y"))
    d_norm = d.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("dn"))
    met = d.join(small(q), "g").groupBy("query_id", "doc_id").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    scored = met.join(d_norm, "doc_id").join(small(q_norm), "query_id").select("query_id", "doc_id", F.round(F.col("s") / (F.col("qn") * F.col("dn")), 6).alias("score"))
    return top_ranked(scored, k).select("query_id", "rank", "doc_id", "score")


def dimension_similarity(long: DataFrame, target, k: int, least_common: int = 3) -> DataFrame:
    """long: entity_id, dim, value. Entities by weighted distance to the target over the dimensions both
    have (at least ``least_common``), divided by the root of their number, rounded to 2 places before sorting;
    more common dimensions first, then the id."""
    weight = F.coalesce(F.element_at(F.create_map(*(x for d, w in WEIGHTS.items() for x in (F.lit(d), F.lit(w)))), F.col("dim")), F.lit(1.0))
    mine = F.broadcast(long.where((F.col("entity_id") == target) & F.col("value").isNotNull()).select("dim", F.col("value").alias("t")))
    met = long.where((F.col("entity_id") != target) & F.col("value").isNotNull()).join(mine, "dim")
    gap = F.col("value") - F.col("t")
    out = met.groupBy("entity_id").agg(F.count("*").cast("int").alias("n_common"), F.sum(weight * gap * gap).alias("s")).where(F.col("n_common") >= least_common)
    out = out.withColumn("distance", F.round(F.sqrt("s") / F.sqrt("n_common"), 2))
    return out.orderBy("distance", F.desc("n_common"), "entity_id").limit(k).select("entity_id", "n_common", "distance")
