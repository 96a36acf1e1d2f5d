"""Evidence: texts that hold a probe, the chunk behind a record, gold answers extended by probe, evidence of others.

A probe is met by anchors. Both sides name places of their texts by content alone: of every ``window`` characters, the
8-gram of least hash. A text that holds a window of a probe has that window's anchor, so probes and texts meet by
equality of anchors, and what meets is verified. About one character in ten is an anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.text import squeeze
from loomspark.operators.numbering import gapless_ids
from loomspark.sources.storage import stored
from loomspark.sources.tables import bounded_batches

GRAM = 8
#: Lengths of windows; a probe uses the longest that is no longer than itself.
WINDOWS = (32, 16)
#: Characters of a probe, at least: shorter ones tell nothing.
LEAST = WINDOWS[-1]


def _least_of(hashes: np.ndarray, span: int) -> np.ndarray:
    """The place of the least of every ``span`` neighbours; of equals the first."""
    at = np.arange(len(hashes))
    width = 1
    while width * 2 <= span:  # runs of doubled width
        a, b = at[:-width], at[width:]
        at = np.where(hashes[b] < hashes[a], b, a)
        width *= 2
    if width < span:
        a, b = at[: len(at) - (span - width)], at[span - width :]
        at = np.where(hashes[b] < hashes[a], b, a)
    return at


def _anchors(texts: list[str], windows: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number of the window, anchor), each once and in this order: all texts are read as one run of characters, and
    windows that lie in two of them are left out."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    out = [np.zeros((3, 0), np.int64)]
    if len(codes) >= GRAM:
        hashes = np.zeros(len(codes) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            hashes = (hashes ^ codes[k : len(codes) - GRAM + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            hashes ^= hashes >> np.uint64(29)
        of = np.repeat(np.arange(len(texts)), sizes)
        for number, window in enumerate(windows):
            if len(codes) < window:
                continue
            least = _least_of(hashes, window - GRAM + 1)
            least = np.unique(least[np.arange(len(least)) + window <= ends[of[: len(least)]]])
            out.append(np.stack([of[least], np.full(len(least), number), hashes[least].view(np.int64)]))
    text, number, anchor = np.concatenate(out, axis=1)
    order = np.lexsort((anchor, number, text))
    found = np.stack([text, number, anchor])[:, order]
    new = np.ones(found.shape[1], bool)
    new[1:] = (found[:, 1:] != found[:, :-1]).any(axis=0)
    return tuple(found[:, new])


def anchors_of(text: str | None, window: int) -> np.ndarray:
    """The distinct anchors of a text, as hashes; none if it is shorter than a window."""
    return np.unique(_anchors([text or ""], (window,))[2].view(np.uint64)).view(np.int64)


def anchors(text: Column) -> Column:
    """The anchors of all WINDOWS, those of the longest first; each window's are told apart by a mark of its own."""
    return F.arrow_udf(_marked, T.ArrayType(T.LongType()))(text)


def _marked(texts: pa.Array) -> pa.Array:
    text, number, anchor = _anchors(pc.fill_null(texts, "").to_pylist(), WINDOWS)
    marked = anchor ^ (number * np.int64(0x5851F42D4C957F2D))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)), pa.array(marked))


def containing(probes: DataFrame, probe_id: str, texts: DataFrame, text_id: str) -> DataFrame:
    """probes: probe_id, probe; texts: text_id, text. Each (probe_id, text_id) whose text holds the probe. Probes shorter
    than LEAST characters are in no text. Ids tell the rows of either side apart."""
    bounded_batches(probes.sparkSession)
    n = F.length("probe")
    # one anchor a probe is enough: that of its first window
    first = F.coalesce(*(F.when(n >= window, F.substring("probe", 1, window)) for window in WINDOWS))
    asked = probes.where(n >= LEAST).select(probe_id, "probe", anchors(first)[0].alias("_a"))
    met = texts.select(text_id, F.explode(anchors(F.col("text"))).alias("_a")).join(asked, "_a").select(probe_id, "probe", text_id)
    return met.join(texts.select(text_id, "text"), text_id).where(F.contains(F.col("text"), F.col("probe"))).select(probe_id, text_id)


def evidence_chunks(records: DataFrame, chunks: DataFrame, longest: int = 60, least: int = 20) -> DataFrame:
    """records: record_id, owner, section, text; chunks: chunk_id, owner, section, content. For each record the chunk
    behind it and how it was found: the first chunk of its owner's and section ('section'); else the first of its
    owner's that holds the text's first ``longest`` squeezed characters, if they are ``least`` or more ('text'); else
    none. Nulls match nothing."""
    same = chunks.where("section is not null").groupBy("owner", "section").agg(F.min("chunk_id").alias("by_section"))
    found = records.join(same, ["owner", "section"], "left")
    probe = F.when(F.col("by_section").isNull() & F.col("owner").isNotNull(), F.substring(squeeze(F.col("text")), 1, longest))
    found = stored(found.select("record_id", "owner", "by_section", probe.alias("probe")), "records")  # read three times
    open_ = found.where(F.length("probe") >= least)
    asked = open_.select(F.struct("record_id", "owner").alias("p"), "probe")
    held = chunks.where("owner is not null").select(F.struct("chunk_id", "owner").alias("t"), squeeze(F.col("content")).alias("text")).join(open_.select(F.col("owner").alias("_o")).distinct(), F.col("t.owner") == F.col("_o"), "left_semi")
    met = containing(asked, "p", held, "t").where("p.owner = t.owner").groupBy(F.col("p.record_id").alias("record_id")).agg(F.min("t.chunk_id").alias("by_text"))
    out = found.select("record_id", "by_section").join(met, "record_id", "left")
    kind = F.when(F.col("by_section").isNotNull(), "section").when(F.col("by_text").isNotNull(), "text")
    return out.select("record_id", F.coalesce("by_section", "by_text").alias("chunk_id"), kind.alias("found_by"))


def gold_by_probe(items: DataFrame, texts: DataFrame, gold: DataFrame, text: Column, lengths: tuple[int, ...] = (60, 40, 20)) -> DataFrame:
    """items: item_id, answer (normalised); texts: text_id and what ``text`` reads; gold: item_id, text_id. For each probe
    length the gold with every text that holds the answer's first characters: n_probe, item_id, text_id, given (whether
    it was gold before)."""
    probes = items.withColumn("n_probe", F.explode(F.array(*map(F.lit, lengths)))).select(F.struct("n_probe", "item_id").alias("p"), F.expr("substring(answer, 1, n_probe)").alias("probe"))
    found = containing(probes, "p", texts.select("text_id", text.alias("text")), "text_id").select("p.n_probe", "p.item_id", "text_id", F.lit(0).alias("g"))
    given = gold.withColumn("n_probe", F.explode(F.array(*map(F.lit, lengths)))).select("n_probe", "item_id", "text_id", F.lit(1).alias("g"))
    return found.unionByName(given).groupBy("n_probe", "item_id", "text_id").agg((F.max("g") == 1).alias("given"))


def others_evidence(pieces: DataFrame, item: str, owner: str, order: list[str]) -> DataFrame:
    """pieces: item, owner, ``order`` and more, in which an item's evidence is of its owner. Each piece with the number of
    the piece that stands in for it: never one of the same owner, and each stands in once where no owner holds more than
    half of all pieces. Pieces are numbered by owner and order; a piece takes the one as far ahead as the largest owner
    has pieces, round and round, so it steps over its own owner's. Where one owner holds more than half that cannot be,
    and its pieces take the others' in turn instead. Adds n and stands_in (null where there is one owner only)."""
    numbered = gapless_ids(pieces, [owner, item, *order], "n", 0)
    owners = numbered.groupBy(owner).agg(F.count("*").alias("_m"), F.min("n").alias("_low"))
    total, most = owners.agg(F.coalesce(F.sum("_m"), F.lit(0)), F.coalesce(F.max("_m"), F.lit(0))).first()
    out = numbered.join(owners, F.equal_null(owners[owner], numbered[owner]), "inner").drop(owners[owner])
    if most * 2 <= total:
        return out.withColumn("stands_in", (F.col("n") + most) % max(total, 1)).drop("_m", "_low")
    others = F.lit(total) - F.col("_m")
    turn = (F.col("_low") + F.col("_m") + (F.col("n") - F.col("_low")) % F.when(others > 0, others)) % total
    return out.withColumn("stands_in", turn).drop("_m", "_low")


def four_settings(items: DataFrame, pieces: DataFrame, item: str, owner: str, order: list[str], content: str) -> DataFrame:
    """The evidence of an item under four settings: own (A, and B where answers are read off), none (C: as many pieces,
    empty) and others' (D). item, setting, n_pieces, evidence (pieces in order, joined by lines)."""
    numbered = others_evidence(pieces, item, owner, order)
    foreign = numbered.join(numbered.select(F.col("n").alias("stands_in"), F.col(content).alias("_other")), "stands_in", "left")
    held = foreign.groupBy(item).agg(F.count("*").alias("n_pieces"), F.array_sort(F.collect_list(F.struct("n", content, "_other"))).alias("x"))
    joined = lambda name: F.array_join(F.transform("x", lambda p: F.coalesce(p[name], F.lit(""))), "\n")
    blank = F.array_join(F.transform("x", lambda p: F.lit("")), "\n")
    settings = F.array(*(F.struct(F.lit(s).alias("setting"), e.alias("evidence")) for s, e in (("A", joined(content)), ("B", joined(content)), ("C", blank), ("D", joined("_other")))))
    every = items.select(item).join(held, item, "left").withColumn("s", F.explode(settings))
    return every.select(item, "s.setting", F.coalesce("n_pieces", F.lit(0)).alias("n_pieces"), F.coalesce("s.evidence", F.lit("")).alias("evidence"))
