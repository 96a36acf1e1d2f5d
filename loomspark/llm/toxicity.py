"""Toxicity by class-conditional Kneser-Ney models of words.

A word is spelt from its start: its first 2, 4, 6, 8 and 12 letters, an end mark behind its last, each step a symbol
whose context is the beginning before it. For each class the counts of all training rows give an interpolated
Kneser-Ney model of these steps. Both classes back off to one distribution: in how many different words, of either
class, a beginning goes on in that way. So a word that neither class has goes by its longest known beginning, and what
is rare in both classes says little for either. Letters are not merged, and the tables grow with the training rows.

The log-ratio of a word, toxic against ordinary, is the sum over its steps. A text's evidence is the mean of the
log-ratios of all its words, so the difference of its two log-likelihoods a word, and the mean of what lies above
``MARGIN`` nats; a logistic curve over both makes the score. It is fitted on a sample of at most ``CURVE_ROWS`` labels,
read by the counts of the other training rows; texts are then scored by the counts of all training rows, the sample
included.

On the cluster: training words are counted by equality; each length of beginnings meets the one before it in a join.
The texts are cut once: rows become numbers of words, and words are listed once a block of rows (at most about
``BLOCK_UNITS`` words or ``BLOCK_ENTRIES`` numbers). The corpus' different words meet the beginnings, which gives each its
log-ratio; these go to the blocks that list the word, and a block's ratios meet its rows' numbers in one task.

Only rows of labels with toxic 0 or 1 whose doc_id is not held out are learnt from: crc32(doc_id as text) modulo 3 other
than 1. Where that sample, or the rows beside it, lack one of the classes, the curve is fitted on labels that are counted
too. Defined results: null and empty texts have the score of no evidence; a null doc_id is not held out and has no label;
of several labels of a doc_id the greatest counts; repeated rows count as often as they stand; without training rows of
both classes every score is below 1e-21; an empty table gives no rows; ``toxicity_scores`` reads no other columns,
``without_toxic`` keeps them all.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import free_names, freed, map_arrow, stored, text_or_empty

#: Lengths of the beginnings of a word; a longer word is told by the last of them.
STEPS = (2, 4, 6, 8, 12)
END = "\u0000"
DISCOUNT, MARGIN = 0.75, 4.0
#: At most so many rows fit the curve, the first by a hash of doc_id.
CURVE_ROWS = 20_000
#: Labels are broadcast up to this number of rows (16 bytes each), joined beyond.
BROADCAST_ROWS = 2_000_000
#: A block is closed beyond so many different words, or so many numbers of words of its rows; its words are listed in rows
#: of at most UNITS_A_ROW.
BLOCK_UNITS, BLOCK_ENTRIES, UNITS_A_ROW = 400_000, 8_000_000, 50_000
FILTER_BITS = 27
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W_]+")


def units_of(text: str) -> list[str]:
    """The words in lower case, each with its end mark, cut to the longest beginning."""
    most = STEPS[-1]
    return [(w + END)[:most] for w in _WORD.findall(text.lower())]


def _counted(rows: DataFrame) -> DataFrame:
    """rows: text, kind. unit, kind, n: the words of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, Counter] = {}
            for text, kind in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held.setdefault(kind, Counter()).update(units_of(text.as_py()))
            for kind, counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array([kind] * len(counts), pa.int32()), pa.array(counts.values(), pa.int64())], ["unit", "kind", "n"])

    return map_arrow(rows.select("text", "kind"), run, "unit string, kind int, n bigint")


def _smoothed(n: str, total: str, kinds: str) -> Column:
    """Interpolated Kneser-Ney; back is the continuation share that both classes have in common."""
    known = (F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(kinds) * F.col("back")) / F.col(total)
    return F.when(F.col(total) > 0, known).otherwise(F.col("back"))


def log_ratios(words: DataFrame) -> DataFrame:
    """words: unit, ordinary, toxic (counts). node, ratio: each beginning with the sum of the log-ratios of its steps."""
    out, before, shorter = [], None, 0
    for size in STEPS:
        at = words.where(F.length("unit") > shorter).groupBy(F.substring("unit", 1, size).alias("node"), F.substring("unit", 1, shorter).alias("parent")).agg(F.sum("ordinary").alias("o"), F.sum("toxic").alias("t"), F.count("*").alias("c"))
        at = stored(at, "beginnings")
        parents = at.groupBy("parent").agg(F.sum("o").alias("all_o"), F.sum("t").alias("all_t"), F.sum("c").alias("all_c"), F.count_if(F.col("o") > 0).alias("kinds_o"), F.count_if(F.col("t") > 0).alias("kinds_t"))
        step = at.join(parents, "parent").withColumn("back", F.col("c") / F.col("all_c"))
        step = step.select("node", "parent", (F.log(_smoothed("t", "all_t", "kinds_t")) - F.log(_smoothed("o", "all_o", "kinds_o"))).alias("ratio"))
        if before is not None:
            step = step.join(before.select(F.col("node").alias("parent"), F.col("ratio").alias("_above")), "parent").withColumn("ratio", F.col("ratio") + F.col("_above"))
        before = stored(step.select("node", "ratio"), "ratios")
        freed(at)
        out.append(before)
        shorter = size
    nodes = out[0]
    for more in out[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def _ratios(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """units: unit, may repeat. unit, ratio: each that has a known beginning, by the longest of them. Most are known whole
    and meet their ratio where they are made distinct; only the others are read by their shorter beginnings."""
    both = units.select("unit", F.lit(True).alias("asked"), F.lit(None).cast("double").alias("ratio")).unionByName(nodes.select(F.col("node").alias("unit"), F.lit(False).alias("asked"), "ratio"))
    once = stored(both.groupBy("unit").agg(F.max("asked").alias("asked"), F.max("ratio").alias("ratio")).where("asked").drop("asked"), "units")
    starts = F.filter(F.array(*(F.when(F.length("unit") > size, F.struct(F.lit(size).alias("size"), F.substring("unit", 1, size).alias("node"))) for size in STEPS[:-1])), lambda s: s.isNotNull())
    met = once.where("ratio is null").select("unit", F.explode(starts).alias("s")).select("unit", "s.size", "s.node").join(nodes, "node")
    ratios = stored(once.where("ratio is not null").unionByName(met.groupBy("unit").agg(F.max_by("ratio", "size").alias("ratio"))), "ratios")
    freed(once)
    return ratios


def _place(unit: str) -> int:
    return zlib.crc32(unit.encode("utf-8", "replace")) & ((1 << FILTER_BITS) - 1)


def _filter(telling: DataFrame) -> np.ndarray:
    """Bits of a table of words, for those who keep one; scores go without it. A row for each 2**15 bits that are met, added up in Spark, so at most 16 MB."""
    place = F.crc32(F.col("unit").cast("binary")).bitwiseAND((1 << FILTER_BITS) - 1)
    rows = telling.select(F.shiftright(place, 15).alias("part"), place.bitwiseAND((1 << 15) - 1).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for batch in rows.toArrow().to_batches():
        for part, bits in zip(*batch.columns, strict=True):
            out[part.as_py() << 12 : (part.as_py() + 1) << 12] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out


class _Numbers(dict):
    """Words by number, a new one for each that is asked for first."""

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        return number


def _with_words(rows: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows: text and carried columns. (carried columns, row_number; packs of the rows' words; block, place, unit: the words
    of each block). A pack has, for the rows from ``low`` on, the number in its block and the times of every different word
    of each, as differences of text * ``words`` + number. Blocks are runs of a task's rows, closed by their size."""
    names = free_names(rows.select(*carried), "row_number", "block", "low", "n", "words", "keys", "times", "base", "units")
    kinds = ["bigint", "bigint", "bigint", "int", "bigint", "binary", "binary", "int", "array<string>"]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried), *(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = block = TaskContext.get().partitionId() << 33
        known, entries, held = _Numbers(), 0, []

        def made(size: int, of_rows: list | None, values: dict[int, list]) -> pa.RecordBatch:
            own = [pa.array(values[i], t) if i in values else pa.nulls(size, t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*(of_rows or [pa.nulls(size, t) for t in held]), *own], [*carried, *names])

        def closed() -> Iterator[pa.RecordBatch]:
            units = list(known)
            for base in range(0, len(units), UNITS_A_ROW):
                yield made(1, None, {1: [block], 7: [base], 8: [units[base : base + UNITS_A_ROW]]})

        for batch in batches:
            held = [c.type for c in batch.columns[: len(carried)]]
            n, sizes, numbers = batch.num_rows, [], []
            for text in batch.column(len(carried)):
                units = units_of(text.as_py())
                sizes.append(len(units))
                numbers.append(np.fromiter(map(known.__getitem__, units), np.int64, len(units)))
            words = max(1, len(known))
            key, times = np.unique(np.repeat(np.arange(n), sizes) * words + np.concatenate([np.zeros(0, np.int64), *numbers]), return_counts=True)
            packed = [zlib.compress(x.tobytes(), 1) for x in (np.diff(key, prepend=0).astype(np.int64), times.astype(np.int32))]
            yield made(n, batch.columns[: len(carried)], {0: np.arange(low, low + n)})
            yield made(1, None, {1: [block], 2: [low], 3: [n], 4: [words], 5: packed[:1], 6: packed[1:]})
            low, entries = low + n, entries + len(key)
            if len(known) > BLOCK_UNITS or entries > BLOCK_ENTRIES:
                yield from closed()
                known, entries, block = _Numbers(), 0, low
        yield from closed()

    table = stored(map_arrow(rows.select(*carried, "text"), run, schema), "words")
    number, block, low, n, words, keys, times, base, units = (F.col(f"`{c}`") for c in names)
    packs = table.where(keys.isNotNull()).select(block.alias("block"), low.alias("low"), n.alias("n"), words.alias("words"), keys.alias("keys"), times.alias("times"))
    listed = table.where(units.isNotNull()).select(block.alias("block"), base.alias("base"), F.posexplode(units).alias("at", "unit"))
    return table.where(number.isNotNull()).select(*carried, names[0]), packs, listed.select("block", (F.col("base") + F.col("at")).alias("place"), "unit")


def _summed(met: pa.Table, packs: pa.Table) -> pa.Table:
    """A block's words (block, place, ratio) and packs. row, mean, excess of each row that has words."""
    ratio = np.zeros(max(packs["words"].to_pylist(), default=1))
    ratio[met["place"].to_numpy()] = met["ratio"].to_numpy()
    above = np.maximum(ratio - MARGIN, 0)
    out = []
    for pack in packs.to_batches(1):
        low, n, words, keys, times = (c[0].as_py() for c in pack.columns[1:])
        text, unit = np.divmod(np.cumsum(np.frombuffer(zlib.decompress(keys), np.int64)), words)
        counts = np.frombuffer(zlib.decompress(times), np.int32)
        size, total, excess = (np.bincount(text, counts * w, n) for w in (np.ones(1), ratio[unit], above[unit]))
        has = np.flatnonzero(size)
        out.append((low + has, total[has] / size[has], excess[has] / size[has]))
    row, mean, excess = (np.concatenate(c) for c in zip((np.zeros(0, np.int64), np.zeros(0), np.zeros(0)), *out, strict=True))
    return pa.table({"row": row, "mean": mean, "excess": excess})


def with_evidence(rows: DataFrame, nodes: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows: text and carried columns. (each row with a number of its own, numbers with mean and excess of the rows that
    have words; a row that is not among these has none). The words' ratios are written before they go to the blocks, so
    that the shuffled words are gone by then."""
    held, packs, units = _with_words(rows, carried)
    ratios = _ratios(units, nodes)
    met = stored(units.join(ratios.hint("merge"), "unit").select("block", "place", "ratio"), "met")
    freed(ratios)
    return held, met.groupBy("block").cogroup(packs.groupBy("block")).applyInArrow(_summed, "row bigint, mean double, excess double")


def _curve(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights (bias first) of a logistic curve over standardised features, by Newton's method with a small ridge."""
    spread = features.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(labels)), features / spread])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.array([0.0, *[0.05] * features.shape[1]])
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge + 1e-6), x.T @ (labels - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([w[:1], w[1:] / spread])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame | None, np.ndarray]:
    """(beginnings with their log-ratios, weights of the curve), from the labelled rows that are not held out; no
    beginnings without rows of both classes."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    small = labels.count() <= BROADCAST_ROWS
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    kept_back = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0

    def first(of: DataFrame) -> DataFrame:
        """The first labels by a hash of doc_id; only ids are sorted."""
        return of.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(CURVE_ROWS)

    def features(sample: DataFrame, nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows, evidence = with_evidence(texts.join(F.broadcast(sample), "doc_id").select("toxic", "text"), nodes, ["toxic"])
        met = rows.join(evidence, F.col("row_number") == F.col("row"), "left").select("toxic", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("excess", F.lit(0.0)).alias("excess"))
        held = stored(met, "features")
        found = held.toPandas()
        freed(rows, evidence, held)
        return found[["mean", "excess"]].to_numpy(), found["toxic"].to_numpy()

    sample = stored(first(known.where(kept_back)), "sample")
    marked = known.join(F.broadcast(sample.select("doc_id", F.lit(2).alias("more"))), "doc_id", "left")
    marked = marked.select("doc_id", (F.col("toxic") + F.coalesce("more", F.lit(0))).alias("kind"))
    rows = texts.join(F.broadcast(marked) if small else marked, "doc_id")
    count = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0))
    words = stored(_counted(rows).groupBy("unit").agg(count(0).alias("ordinary_rest"), count(1).alias("toxic_rest"), count(0, 2).alias("ordinary"), count(1, 3).alias("toxic")), "training_words")
    totals = words.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in words.columns[1:])).first()
    if not (totals[2] and totals[3]):
        return None, np.array([-50.0, 0.0, 0.0])
    nodes, fitted = log_ratios(words.select("unit", "ordinary", "toxic")), None
    if totals[0] and totals[1]:
        rest = words.select("unit", F.col("ordinary_rest").alias("ordinary"), F.col("toxic_rest").alias("toxic")).where("ordinary + toxic > 0")
        less = log_ratios(rest)
        fitted = features(sample, less)
        freed(less)
    if fitted is None or len(set(fitted[1].tolist())) < 2:  # the sample, or what is left beside it, lacks a class
        fitted = features(stored(first(known), "sample"), nodes)
    freed(words, sample)
    return nodes, _curve(*fitted)


def _scored(rows: DataFrame, labels: DataFrame, carried: list[str], docs: DataFrame) -> tuple[DataFrame, DataFrame, Column, float]:
    """(rows with a number in their last column, evidence, the score of a row of evidence, the score of none)"""
    nodes, (bias, by_mean, by_excess) = train(docs, labels)
    none = 1 / (1 + np.exp(-bias))
    if nodes is None:
        number = free_names(rows.select(*carried), "row_number")[0]
        held = rows.select(*carried).withColumn(number, F.monotonically_increasing_id())
        return held, rows.sparkSession.createDataFrame([], "row bigint, mean double, excess double"), F.lit(none), none
    held, evidence = with_evidence(rows, nodes, carried)
    freed(nodes)
    score = 1 / (1 + F.exp(-(F.lit(float(bias)) + F.col("mean") * float(by_mean) + F.col("excess") * float(by_excess))))
    return held, evidence, score, float(none)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    rows, evidence, score, none = _scored(docs.select("doc_id", text_or_empty().alias("text")), labels, ["doc_id"], docs)
    met = rows.join(evidence.select("row", score.alias("score")), F.col(rows.columns[-1]) == F.col("row"), "left")
    return met.select("doc_id", held_out().alias("held_out"), F.coalesce("score", F.lit(none)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, all columns as they are."""
    rows, evidence, score, none = _scored(docs.select(F.struct(*docs.columns).alias("row"), text_or_empty().alias("text")), labels, ["row"], docs)
    if none >= threshold:  # then what is to stay needs evidence
        gone = rows.select(F.col(rows.columns[-1]).alias("_row")).join(evidence.where(score < threshold).select(F.col("row").alias("_row")), "_row", "left_anti")
    else:
        gone = stored(evidence.where(score >= threshold).select(F.col("row").alias("_row")), "toxic")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    kept = rows.join(gone, F.col(rows.columns[-1]) == F.col("_row"), "left_anti")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
