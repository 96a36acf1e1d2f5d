"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

1. Sources in code point order, null last, weigh 5, 2, 1, 5, ... and share the words of the whole corpus. A source
   stops at ``most`` times its own words; what it cannot take is shared anew by weight, until none is above.
   The share of a weight is an exact fraction; each round reads one row of sums from the table of sources.
2. A source's documents, in the order of their keys' MD5, form one stream of words, read round and round. A document's
   place is a running total over buckets of that order, so a hot source is no single task.
3. The schedule has N = 2**m slots. Slot t takes the van der Corput point of t, the bits of t reversed, as a number k
   below N; the sources own intervals of k in proportion to their words (one k at least). The k-th's rank among its
   source's slots is counted in closed form, so no window runs over the slots.
4. Rank r of a source is its r-th block: of its words to take, block r holds those from r/n on, equal up to one word.
   Blocks meet slots by (source, rank); each slot then names spans of documents.

So every source's taken words are its target rounded down, any stretch of slots holds the sources close to their
shares, and no document is taken more than ``most`` times over. The result depends on the rows alone.

Defined results: null, empty and blank texts have no words and are never taken; a null doc_id is a key like others; rows
that repeat are taken one after the other; a null source is one source, the last; an empty table, or one without words,
gives no spans; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import map_arrow, stored
from loomspark.operators.numbering import gapless_ids, running_total

WEIGHTS = (5, 2, 1)
#: A source is read at most so many times.
MOST = 3
#: Words of a block, about: it has between half of this and all of it.
BLOCK_WORDS = 512
#: Rows of a bucket of a source's stream, about, were there one source alone.
BUCKET_ROWS = 256
#: Slots that one row of the schedule makes.
SLOTS = 4096
BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "idx bigint, rank bigint, slot bigint"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than U+0020 and U+0009 to U+000D; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(bare == "", F.lit(0).cast("long")).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+")).cast("long"))


def reversed_bits(k: np.ndarray, m: int) -> np.ndarray:
    """The m low bits of each k in opposite order."""
    out = np.zeros_like(k)
    for bit in range(m):
        out |= ((k >> bit) & 1) << (m - 1 - bit)
    return out


def points_before(x: np.ndarray, t: np.ndarray, m: int) -> np.ndarray:
    """How many k < x (x at most 2**m) have reversed bits below t: [0, x) is cut into one dyadic interval for each
    bit of x, in which the reversed bits are an arithmetic progression."""
    out = np.zeros_like(t)
    for j in range(m + 1):
        start = (x >> j) - 1  # of the interval [start << j, (start + 1) << j), where bit j of x is set
        first, step = reversed_bits(np.maximum(start, 0), m - j), 1 << (m - j)
        inside = np.clip(-((first - t) // step), 0, 1 << j)
        out += np.where((x >> j) & 1 == 1, inside, 0)
    return out


def schedule(intervals: DataFrame, m: int) -> DataFrame:
    """intervals: idx, low, high, numbers k below 2**m. One row a slot: idx, rank (of the slot among its source's,
    in the order of slots), slot."""
    parts = intervals.where("low < high").withColumn("part", F.explode(F.sequence("low", F.col("high") - 1, F.lit(SLOTS).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for idx, low, high, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k = np.arange(part, min(part + SLOTS, high), dtype=np.int64)
                t = reversed_bits(k, m)
                rank = points_before(np.full_like(k, high), t, m) - points_before(np.full_like(k, low), t, m)
                yield pa.RecordBatch.from_arrays([pa.array(np.full_like(k, idx)), pa.array(rank), pa.array(t)], ["idx", "rank", "slot"])

    return map_arrow(parts.select("idx", "low", "high", "part").repartition("part"), run, SCHEMA)


def shares(sources: DataFrame, weights: tuple[int, ...], most: int) -> dict[int, Fraction]:
    """sources: weight, words. The words that each weight takes of a source that is not stopped."""
    words = F.col("words").cast("decimal(38,0)")
    total, count = sources.agg(F.coalesce(F.sum(words), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    total, level = int(total), Fraction(int(total), int(count) or 1)
    while total:
        # stopped: most * words <= level * weight, in whole numbers
        stopped = words * F.lit(most * level.denominator).cast("decimal(38,0)") <= F.col("weight") * F.lit(level.numerator).cast("decimal(38,0)")
        taken, left = sources.agg(F.coalesce(F.sum(F.when(stopped, words * most)), F.lit(0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0))).first()
        again = Fraction(total - int(taken), int(left)) if left else level
        if again <= level:
            break
        level = again
    return {w: level * w for w in set(weights)}


def plan_sources(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """rows: nameless, source, size, copies. One row a source: idx, nameless, source, words, target, quota (words to take)."""
    sources = rows.groupBy("nameless", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    sources = gapless_ids(sources, ["nameless", "source"], "idx")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int"))
    sources = stored(sources.withColumn("weight", turn), "sources")
    level = shares(sources, weights, most)
    free_target, free_quota = F.lit(0.0), F.lit(0).cast("long")
    for w, share in level.items():
        free_target = F.when(F.col("weight") == w, F.lit(float(share))).otherwise(free_target)
        free_quota = F.when(F.col("weight") == w, F.lit(int(share)).cast("long")).otherwise(free_quota)
    cap = F.col("words") * most
    return sources.select("idx", "nameless", "source", "words", F.least(cap.cast("double"), free_target).alias("target"), F.least(cap, free_quota).alias("quota"))


class Mix:
    """The mix of ``docs`` (doc_id, text, source): ``documents`` has a row for each row of docs, ``spans`` the
    schedule's blocks as spans of words of documents."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS):
        key = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("nameless"), F.coalesce("source", F.lit("")).alias("source"), word_count(F.col("text")).alias("size")]
        rows = stored(docs.select(*key).groupBy("doc_id", "nameless", "source", "size").agg(F.count("*").alias("copies")), "sizes")
        sources = stored(plan_sources(rows, weights, most), "targets")
        n, total, used = sources.agg(F.count("*"), F.sum("quota"), F.count(F.when(F.col("quota") > 0, 1))).first()
        self.m, self.most = max(2 * used - 1, (total or 0) // block_words).bit_length(), most
        self.sources = self._intervals(sources, n, total or 0, used)
        self.documents = self._placed(rows)

    def _intervals(self, sources: DataFrame, n: int, total: int, used: int) -> DataFrame:
        """sources with low, high: each used source has one number and its share of the others."""
        bits = max(1, (max(n, 1) - 1).bit_length())
        sources = sources.withColumn("bucket", F.shiftright("idx", 8)).withColumn("one", (F.col("quota") > 0).cast("long"))
        for value, name in (("quota", "words_before"), ("one", "used_before")):
            sources = running_total(sources, [], "bucket", max(1, bits - 8), ["idx"], F.col(value), name)
        out = sources.withColumn("_low", F.col("words_before")).withColumn("_high", F.col("words_before") + F.col("quota"))
        whole = lambda x: F.expr(f"cast((cast({x} as decimal(19,0)) * {(1 << self.m) - used}BD) div {total or 1}BD as bigint)")
        out = out.withColumn("low", F.col("used_before") + whole("_low")).withColumn("high", F.col("used_before") + F.col("one") + whole("_high"))
        return stored(out.select("idx", "nameless", "source", "words", "target", "quota", "low", "high"), "intervals")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """One row a document: doc_id, source, size, copy and its source's columns, with its first word's place."""
        bits = min(32, max(1, (rows.count() // BUCKET_ROWS).bit_length()))
        rows = rows.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")))
        rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits))
        size = F.col("size") * F.col("copies")
        # placed by source and bucket; the sources' columns come through one row for each of these
        placed = running_total(rows, ["nameless", "source"], "bucket", bits, ["key", F.col("doc_id").asc_nulls_first(), "size"], size, "place")
        held = rows.select("nameless", "source", "bucket").distinct().join(self.sources, ["nameless", "source"])
        placed = placed.join(held, ["nameless", "source", "bucket"])
        step = 1 << 16  # copies of one row, in two steps
        placed = placed.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(step).cast("long"))))
        placed = placed.withColumn("copy", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + step, F.col("copies")) - 1)))
        return stored(placed.select("idx", "nameless", "source", "doc_id", "size", "copy", (F.col("place") + F.col("copy") * F.col("size")).alias("place"), "words", "target", "quota", (F.col("high") - F.col("low")).alias("slots")), "placed")

    def spans(self) -> DataFrame:
        """slot, at (word of the block), doc_id, source, size, copy, first (word of the document), n_words. Ordered
        by slot and at, these are the mix."""
        turns = self.documents.where("size > 0 and quota > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(self.most - 1))))
        turns = turns.withColumn("low", F.col("place") + F.col("turn") * F.col("words")).withColumn("high", F.least(F.col("low") + F.col("size"), F.col("quota"))).where("low < high")
        # block r holds the words from floor(r * quota / slots) on
        rank_of = lambda x: f"cast(((cast({x} as decimal(19,0)) + 1) * slots - 1) div cast(quota as decimal(19,0)) as bigint)"
        start_of = lambda r: f"cast((cast({r} as decimal(19,0)) * quota) div cast(slots as decimal(19,0)) as bigint)"
        parts = turns.withColumn("rank", F.explode(F.sequence(F.expr(rank_of("low")), F.expr(rank_of("high - 1")))))
        parts = parts.withColumn("_begins", F.expr(start_of("rank"))).withColumn("_ends", F.expr(start_of("rank + 1")))
        parts = parts.withColumn("_from", F.greatest("low", "_begins")).withColumn("n_words", F.least("high", "_ends") - F.col("_from")).where("n_words > 0")
        times = schedule(self.sources.select("idx", "low", "high"), self.m)
        return parts.join(times, ["idx", "rank"]).select(
            "slot", (F.col("_from") - F.col("_begins")).alias("at"), "doc_id", F.when(~F.col("nameless"), F.col("source")).alias("source"), "size", "copy", (F.col("_from") - F.col("low")).alias("first"), "n_words"
        )


def mix_digests(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken."""
    mix = Mix(docs)
    key = ["doc_id", "source", "size", "copy"]
    every = mix.documents.select("doc_id", F.when(~F.col("nameless"), F.col("source")).alias("source"), "size", "copy", F.col("words").alias("source_size"), "target", F.lit(0).cast("long").alias("n_words"))
    taken = mix.spans().select(*key, F.lit(None).cast("long").alias("source_size"), F.lit(None).cast("double").alias("target"), "n_words")
    both = every.unionByName(taken).groupBy(*key).agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("n_words").alias("taken"))
    return both.select("doc_id", "size", "source_size", "target", "taken")
