"""Phrase collocations by merged count-min sketches and one exact count of the survivors.

1. Each batch of texts sketches its phrases of 1 to ``longest`` words: a phrase's hash names one cell in each of two rows
   of 2**bits cells. The width follows the corpus, a cell for 16 to 32 bytes of text. A batch's sketch leaves its task as
   sorted cells and counts, in blocks; blocks of the same place are added up, which merges the sketches. An estimate is
   the least of a phrase's cells, so it never lies below the count.
2. Cells of at least ``least`` become a bit each. These bits, at most 2 * 2**28 (64 MB) whatever the corpus, are broadcast.
3. A second pass over the texts keeps the phrases whose bits are set, and whose shorter phrases are kept, and counts them
   as strings. Nothing of at least ``least`` is lost, and what was kept by chance is dropped by its exact count.
4. Candidates meet the counts of their parts by equality, are scored by their weakest cut in exact decimals, and give way to
   longer candidates that hold most of their occurrences.

Only the filter's sharpness depends on its width: a wider corpus than 2**28 cells can tell apart lets more phrases through
to the exact count.

Defined results: null and empty texts have no words; a null lang is ``und``, as is the lang of that name; rows that repeat
count again; a null doc_id changes nothing, as ids are not read; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import map_arrow, stored, text_or_empty, utf8
from loomspark.llm.rolling import mixed

LONGEST, LEAST, TOP = 4, 30, 2000
ROWS = 2
#: Cells of a block of a sketch, as a power of two: 16-bit numbers name them.
BLOCK_BITS = 16
#: Bits of the broadcast filter for each row of the sketch, at most, as a power of two.
FILTER_BITS = 28
#: Words whose phrases are held at a time.
STEP = 1 << 21

_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SALT = np.random.Generator(np.random.PCG64(12)).integers(1, 1 << 63, ROWS, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """The words of a batch: their numbers in ``known``, their texts' lang, and the pieces that hold them."""

    known: pa.Array
    word: np.ndarray
    lang: np.ndarray
    piece: np.ndarray
    langs: pa.Array


def words_of(langs: pa.Array, texts: pa.Array) -> Words:
    data, offsets = utf8(texts)
    kind = _KIND[data]
    held = kind == 0
    first, last = held.copy(), held.copy()
    first[1:] &= ~held[:-1]
    last[:-1] &= ~held[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge], last[edge - 1] = held[edge], held[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(_LOWER[data[held]])).dictionary_encode()
    text = np.searchsorted(offsets, starts, "right") - 1
    of_text = langs.dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy().astype(np.int64), of_text.indices.to_numpy().astype(np.int64)[text], np.cumsum(kind == 2)[starts] + text, of_text.dictionary)


def hashes_of(strings: pa.Array) -> np.ndarray:
    return pd.util.hash_array(strings.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(strings) else np.zeros(0, np.uint64)


def phrase_hashes(words: Words, longest: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, ...: (which words from ``low`` to ``high`` begin a phrase of n words, the phrases' hashes)."""
    stop = min(high + longest - 1, len(words.word))
    one = mixed(hashes_of(words.known)[words.word[low:stop]] + hashes_of(words.langs)[words.lang[low:stop]] * _ODD)
    piece, many = words.piece[low:stop], one
    whole = np.arange(stop - low) < high - low
    for n in range(1, longest + 1):
        if n > 1:
            many = mixed(many[:-1] * _ODD + one[n - 1 :])
        yield whole[: len(many)] & (piece[: len(many)] == piece[n - 1 :]), many


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mixed(hashes ^ _SALT[row]) >> np.uint64(64 - bits)


def sketch_bits(n_bytes: int) -> int:
    """Width of a row of the sketch: a cell for 16 to 32 bytes of text."""
    return max(BLOCK_BITS, (max(n_bytes, 1) // 16).bit_length())


def block_bits(bits: int) -> int:
    """Cells of a block: more than 2**16 only in sketches wider than 2**28, where a batch meets few cells of a block."""
    return BLOCK_BITS + max(0, bits - FILTER_BITS) // 2


SKETCH = "row int, block bigint, cells binary, counts binary"


def sketches(docs: DataFrame, bits: int, longest: int) -> DataFrame:
    """docs: lang, text. The sketches of the batches, in blocks: cells of the block in order, their counts up to 255."""
    wide, small = block_bits(bits), np.uint16 if block_bits(bits) <= 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(*batch.columns)
            for low in range(0, len(words.word), STEP):
                hashes = np.concatenate([many[begins] for begins, many in phrase_hashes(words, longest, low, min(low + STEP, len(words.word)))])
                for row in range(ROWS):
                    cells = np.sort(cells_of(hashes, row, bits))
                    at = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
                    counts = np.minimum(np.diff(np.append(at, len(cells))), 255).astype(np.uint8)
                    cells = cells[at]
                    block = (cells >> np.uint64(wide)).astype(np.int64)
                    cuts = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), len(block))
                    held = (cells & np.uint64((1 << wide) - 1)).astype(small)
                    packed = [pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (held, counts)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts) - 1, row, np.int32)), pa.array(block[cuts[:-1]]), *packed], ["row", "block", "cells", "counts"])

    return map_arrow(docs, run, SKETCH)


def merged_bits(parts: DataFrame, bits: int, least: int) -> DataFrame:
    """row, block, bits: the cells of the merged sketch of at least ``least``, a bit each, or for each cell of the filter."""
    wide, small = block_bits(bits), np.uint16 if block_bits(bits) <= 16 else np.uint32
    fold = 1 << max(0, bits - FILTER_BITS)

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << wide, np.uint32)
        for cells, counts in zip(table["cells"], table["counts"], strict=True):
            total[np.frombuffer(cells.as_buffer(), small)] += np.frombuffer(counts.as_buffer(), np.uint8)
        found = (total >= least).reshape(-1, fold).any(axis=1)
        return pa.table({"row": table["row"][:1], "block": table["block"][:1], "bits": pa.array([np.packbits(found).tobytes()], pa.binary())})

    return parts.groupBy("row", "block").applyInArrow(merge, "row int, block bigint, bits binary")


def heavy_filter(docs: DataFrame, bits: int, least: int, longest: int) -> list[np.ndarray]:
    """The filter's bits for each row; at most 2**FILTER_BITS each."""
    parts = stored(merged_bits(sketches(docs, bits, longest), bits, least), "sketch")
    out = [np.zeros(1 << (min(bits, FILTER_BITS) - 3), np.uint8) for _ in range(ROWS)]
    for batch in parts.toArrow().to_batches():
        for row, block, found in zip(*(batch.column(i) for i in range(3)), strict=True):
            found = np.frombuffer(found.as_buffer(), np.uint8)
            at = block.as_py() * len(found)
            out[row.as_py()][at : at + len(found)] = found
    return out


def kept(hashes: np.ndarray, bits: int, rows: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for row, found in enumerate(rows):
        cell = (cells_of(hashes, row, bits) >> np.uint64(max(0, bits - FILTER_BITS))).astype(np.int64)
        out &= (found[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return out


COUNTS = "lang string, n int, phrase string, f bigint"


def counted(words: Words, bits: int, rows: list[np.ndarray], longest: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """COUNTS of the phrases that begin from ``low`` to ``high`` and that the filter keeps. Phrases of a batch are told apart
    by numbers: of their first n - 1 words and of the last."""
    size = len(words.known)
    number = words.lang[low : high + longest - 1] * size
    before = None
    for n, (begins, many) in enumerate(phrase_hashes(words, longest, low, high + longest), 1):
        many, begins = many[: len(number)], begins[: len(number)]
        if before is not None:
            begins = begins & before[: len(begins)] & np.append(before[1:], False)[: len(begins)]
        at = np.flatnonzero(begins)
        at = at[kept(many[at], bits, rows)]
        before = np.zeros(len(begins), bool)
        before[at] = True
        key = (number[at] if n == 1 else number[at] * size) + words.word[low + at + n - 1]
        found, which = np.unique(key, return_inverse=True)
        number = np.zeros(len(number), np.int64)
        number[at] = which
        mine = at < high - low
        counts = np.bincount(which[mine], minlength=len(found))
        where = np.zeros(len(found), np.int64)
        where[which] = low + at
        where, counts = where[counts > 0], counts[counts > 0]
        parts = [words.known.take(pa.array(words.word[where + k])) for k in range(n)]
        phrase = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
        yield pa.RecordBatch.from_arrays([words.langs.take(pa.array(words.lang[where])), pa.array(np.full(len(where), n, np.int32)), phrase, pa.array(counts)], ["lang", "n", "phrase", "f"])


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, n, phrase, f: every phrase of 1 to ``longest`` words and at least ``least`` occurrences, with its count; and
    for each lang a row of n = 0 with the number of its words."""
    spark = docs.sparkSession
    held = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    bits = sketch_bits(held.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0])
    rows = spark.sparkContext.broadcast(heavy_filter(held, bits, least, longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(*batch.columns)
            n = np.bincount(words.lang, minlength=len(words.langs))
            yield pa.RecordBatch.from_arrays([words.langs, pa.array(np.zeros(len(n), np.int32)), pa.array([""] * len(n), pa.string()), pa.array(n)], ["lang", "n", "phrase", "f"])
            for low in range(0, len(words.word), STEP):
                yield from counted(words, bits, rows.value, longest, low, min(low + STEP, len(words.word)))

    return map_arrow(held, run, COUNTS).groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("n") == 0))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, percent: int = 80, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's best phrases of 2 to ``longest`` words."""
    counts = stored(phrase_counts(docs, least, longest), "phrases")
    grams = counts.where("n > 0").select("lang", "phrase", "f")
    found = counts.where("n > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.withColumn("head", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")).withColumn("tail", F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ")).drop("w")
    for part, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(grams.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    score = F.expr("cast((2000000 * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + r) as bigint)")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    inner = found.where(F.size("w") > 2).withColumn("m", F.explode(F.sequence(F.lit(2), F.size("w") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    wide = F.lit(100).cast("decimal(10,0)") * F.col("longer") >= F.lit(percent).cast("decimal(10,0)") * F.col("a")
    left = weakest.join(inner, ["lang", "phrase"], "left").where(~F.coalesce(wide, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    n = counts.where("n = 0").select("lang", F.col("f").alias("n"))
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "x.l", "x.r", "n", "x.score")
