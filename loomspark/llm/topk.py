"""Exact top-k inner products by no-random-access aggregation.

Each component of the vectors of a block is a list sorted by value, read from the top for queries whose
weight there is positive and from the bottom where it is negative. A first few vectors of a block (``SEED``)
are read through, so that each query has k whole scores: its bar. The others are read in steps of depth. After a step,
a vector's upper bound takes the last value read for each component not yet seen, its lower bound the
list's worst value; the bar rises to the k-th best lower bound. An outsider whose upper bound is below the bar
cannot qualify. A query stops reading when ``SLACK`` times k vectors or fewer are left; their scores are
resolved to the end. Up to ``STEP`` queries are bounded at once by matrix products; the arithmetic is exact, in
floats while products stay below 2**24 or 2**53, else in integers.

Vectors are dealt by row into blocks of bounded size, blocks into at most ``GROUPS`` groups. A task holds up to twice
``QUERIES`` queries and reads a group's blocks one after another: a query's k best so far are its bar in the next block,
and reading begins a step above the depth at which the block before stopped. A query keeps k rows for each group, merged by a window.
Queries are written once for each group, vectors once for each part of the queries, never as pairs of rows.

Defined results: rows with a null id, a null vector, or null or non-finite components take no part; rows
with equal ids are vectors of their own, each a query and a candidate of the other; shorter vectors are padded
with noughts; ties go to the smaller id; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import map_arrow, stored

#: Vectors to a block, queries to a part, queries that a task bounds at once, groups of blocks, scores resolved at once.
VECTORS, QUERIES, STEP, GROUPS, PAIRS = 4096, 4096, 512, 48, 1 << 15
SEED = 256
#: Shares of a list that are read, step by step; the last is all of it.
DEPTHS = (1 / 16, 1 / 4, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1)
#: A query stops reading when this many times k vectors could still qualify.
SLACK = 16


def _kth(values: np.ndarray, k: int, least: float) -> np.ndarray:
    """The k-th greatest of each row, or ``least`` where there are fewer."""
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k] if k <= values.shape[1] else np.full(len(values), least)


def read_lists(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lists: the components behind the seed, each sorted upwards; place: where each component stands in its list)"""
    rest = x[SEED:]
    order = np.argsort(rest, axis=0, kind="stable")
    place = np.empty(rest.shape, np.int32)
    np.put_along_axis(place, order, np.arange(len(rest), dtype=np.int32)[:, None], axis=0)
    return np.take_along_axis(rest, order, axis=0), place


def _scores(x: np.ndarray, q: np.ndarray, ask: np.ndarray, at: np.ndarray) -> np.ndarray:
    parts = [np.einsum("ij,ij->i", q[ask[low : low + PAIRS]], x[at[low : low + PAIRS]]) for low in range(0, len(ask), PAIRS)]
    return np.concatenate([np.zeros(0, np.int64), *(p.astype(np.int64) for p in parts)])


def first_k(ask: np.ndarray, order: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Places of each query's first k by the keys of ``order`` (the last of them counts most), by query."""
    by = np.lexsort((*order, ask))
    return by[np.arange(len(by)) - np.searchsorted(ask[by], ask[by]) < k]


def block_top(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, q_rows: np.ndarray, q: np.ndarray, k: int, bar: np.ndarray | None = None, first: int = 0, lists: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows of query's place, vector's place, score: each query's best k of one block, its own row left out; the share
    of the lists that each query read). x, q: int64; ties go to the smaller id, then the smaller row. ``bar``: scores below
    it are of no use to the query; ``first``: the step of ``DEPTHS`` that reading begins with; ``lists``: ``read_lists`` of x."""
    if not len(rows) or not len(q_rows):
        return np.zeros((0, 3), np.int64), np.zeros(len(q_rows))
    low_list, place = lists or read_lists(x)
    width = max(x.shape[1], q.shape[1])
    x, q, low_list, place = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q, low_list, place))
    peak = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, width)
    kind = np.float32 if peak < 2**24 else np.float64 if peak < 2**53 else np.int64
    x, q, low_list = x.astype(kind), q.astype(kind), low_list.astype(kind)
    least = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    order = np.argsort(rows)
    own = order[np.minimum(np.searchsorted(rows, q_rows, sorter=order), len(rows) - 1)]
    own = np.where(rows[own] == q_rows, own, -1)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    seed, rest, n = x[:SEED], x[SEED:], len(x) - SEED
    known = q @ seed.T
    here = np.flatnonzero((own >= 0) & (own < SEED))
    known[here, own[here]] = least
    bar = np.maximum(_kth(known, k, least), least if bar is None else bar.astype(kind))
    left, read = np.arange(len(q)), np.full(len(q), min(1.0, SEED / len(x)))
    asks, ables = [], []
    for share in DEPTHS[first:]:
        if n > 0:
            depth = max(1, int(np.ceil(n * share)))
            done = depth >= n
            read[left] = (SEED + depth) / len(x)
            seen_top, seen_low = place >= n - depth, place < depth
            p, m = up[left], down[left]
            mine = np.flatnonzero(own[left] >= SEED)

            def bound(top: np.ndarray, low: np.ndarray, of: np.ndarray) -> np.ndarray:
                out = p[of] @ np.where(seen_top, rest, top).T + m[of] @ np.where(seen_low, rest, low).T  # noqa: B023
                at = mine[of[mine]]  # noqa: B023
                out[np.cumsum(of)[at] - 1, own[left][at] - SEED] = least  # noqa: B023
                return out

            upper = bound(low_list[n - depth], low_list[depth - 1], np.ones(len(left), bool))
            rivals = upper >= bar[left][:, None]
            many = rivals.sum(axis=1) > SLACK * k
            if many.any():  # their bars rise before they read on
                lower = upper[many] if done else bound(low_list[0], low_list[-1], many)
                bar[left[many]] = np.maximum(bar[left[many]], _kth(lower, k, least))
                rivals[many] = upper[many] >= bar[left[many]][:, None]
        else:
            done, rivals = True, np.zeros((len(left), 0), bool)
        stop = (rivals.sum(axis=1) <= SLACK * k) | done
        line, at = np.nonzero(rivals[stop])
        seeded, seed_at = np.nonzero(known[left[stop]] >= bar[left[stop]][:, None])
        asks += [left[stop][line], left[stop][seeded]]
        ables += [SEED + at, seed_at]
        left = left[~stop]
        if not len(left):
            break
    ask, able = np.concatenate(asks), np.concatenate(ables)
    ask, able = ask[able != own[ask]], able[able != own[ask]]
    score = _scores(x, q, ask, able)
    best = first_k(ask, (rows[able], ids[able], -score), k)
    return np.column_stack([ask[best], able[best], score[best]]), read


def _blocks(vectors: DataFrame, buckets: int, most: int) -> DataFrame:
    """bucket, rows, ids, width, body (int64 components): rows of a bucket packed together, at most ``most`` to a block."""

    def run(batches):
        now, held, bodies = None, [], []

        def flush():
            width = max(map(len, bodies))
            body = np.zeros((len(bodies), width), np.int64)
            for i, r in enumerate(bodies):
                body[i, : len(r)] = r
            rows, ids = (np.array(c, np.int64).tobytes() for c in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([rows]), pa.array([ids]), pa.array([width], pa.int32()), pa.array([body.tobytes()], pa.binary())], ["bucket", "rows", "ids", "width", "body"])

        for batch in batches:
            bucket, row, vec_id = (batch.column(i).to_pylist() for i in range(3))
            for i, vector in enumerate(batch.column(3)):
                if held and (bucket[i] != now or len(held) >= most):
                    yield flush()
                    held, bodies = [], []
                now = bucket[i]
                held.append((row[i], vec_id[i]))
                bodies.append(vector.values.to_numpy())
        if held:
            yield flush()

    dealt = vectors.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int")).select("bucket", "row", "vec_id", "vector")
    return map_arrow(dealt.repartition("bucket").sortWithinPartitions("bucket", "row"), run, "bucket int, rows binary, ids binary, width int, body binary")


def usable_vectors(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """row, vec_id, vector (components floor(256 * x)) of the rows that take part."""
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e")).where(F.col("vec_id").isNotNull() & F.col("e").isNotNull())
    rows = rows.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("e", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))


def _matrix(body: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(body, np.int64).reshape(rows, width)


def _depth(read: np.ndarray) -> int:
    """The step of ``DEPTHS`` before the one at which most queries have stopped."""
    return max(0, int(np.searchsorted(DEPTHS, np.median(read), "right")) - 2)


def top_k(table: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of each row that ``queries`` (a condition on vec_id) picks."""
    vectors = stored(usable_vectors(table, vec_id, embedding), "vectors")
    asked = vectors.where(queries)
    n, m = vectors.count(), asked.count()
    buckets, parts = max(1, -(-n // VECTORS)), max(1, -(-m // QUERIES))
    groups = min(buckets, GROUPS)
    body = ("rows", "ids", "width", "body")
    ask = stored(_blocks(asked, parts, 2 * QUERIES), "queries").select(F.col("bucket").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("in_group"), F.lit(-1).alias("bucket"), *body)
    held = _blocks(vectors, buckets, 2 * VECTORS).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), (F.col("bucket") % groups).alias("in_group"), "bucket", *body)

    def run(batches):
        now, asking, first = None, [], 0

        def flush():
            for q_rows, q_ids, _, score, item, row in asking:
                line, at = np.nonzero(row >= 0)
                columns = [q_rows[line], q_ids[line], row[line, at], item[line, at], score[line, at]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "query_id", "row", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                part, group, bucket, rows, ids, width, held_body = (batch.column(c)[i].as_py() for c in range(7))
                if (part, group) != now:
                    yield from flush()
                    now, asking, first = (part, group), [], 0
                rows, ids = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64)
                x = _matrix(held_body, len(rows), width)
                if bucket < 0:
                    for low in range(0, len(rows), STEP):
                        of = slice(low, low + STEP)
                        size = (len(rows[of]), k)
                        asking.append([rows[of], ids[of], x[of], np.full(size, np.iinfo(np.int64).min), np.zeros(size, np.int64), np.full(size, -1)])
                    continue
                lists, reads = read_lists(x), []
                for one in asking:
                    q_rows, _, q, score, item, row = one
                    found, read = block_top(rows, ids, x, q_rows, q, k, score[:, -1], first, lists)
                    reads.append(read)
                    line = np.append(found[:, 0], np.repeat(np.arange(len(q)), k))
                    score, item, row = np.append(found[:, 2], score), np.append(ids[found[:, 1]], item), np.append(rows[found[:, 1]], row)
                    best = first_k(line, (row, item, -score, row < 0), k)
                    one[3:] = (c[best].reshape(-1, k) for c in (score, item, row))
                if reads:
                    first = _depth(np.concatenate(reads))
        yield from flush()

    dealt = ask.unionByName(held).repartition(4 * parts * groups, "part", "in_group").sortWithinPartitions("part", "in_group", "bucket")
    found = map_arrow(dealt, run, "query bigint, query_id bigint, row bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
