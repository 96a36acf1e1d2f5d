"""Cutting owners' texts into chunks and packing chunks, with lineage to the rows they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import squeeze


def split_chunks(docs: DataFrame, least: int = 0) -> DataFrame:
    """doc_id, pos, content: the lines of documents of at least ``least`` characters."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "content"))
    return lines.where(F.length("content") >= least)


def keep_first(chunks: DataFrame, owner: str, *same: str) -> DataFrame:
    """Of the chunks of an owner that are alike in ``same``, the first."""
    w = Window.partitionBy(owner, *same).orderBy("pos")
    return chunks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _lengths(chunks: DataFrame, owner: str) -> DataFrame:
    """owner, pos, c (squeezed, not blank), low (characters of the owner's squeezed chunks before it, a space behind each)."""
    cleaned = chunks.select(owner, "pos", squeeze(F.col("content")).alias("c")).where("c <> ''")
    before = Window.partitionBy(owner).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return cleaned.withColumn("low", F.coalesce(F.sum(F.length("c") + 1).over(before), F.lit(0)))


def fixed_windows(chunks: DataFrame, owner: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """An owner's squeezed chunks, in order and joined by spaces, cut into windows of ``size`` characters
    every ``size - overlap``. Texts that fit are one window; the last window may lie inside the one before; blank pieces
    end the owner."""
    step = max(size - overlap, 1)
    cleaned = chunks.withColumn("c", squeeze(F.col("content"))).where("c <> ''")
    joined = cleaned.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("x")).select(owner, F.array_join("x.c", " ").alias("text"))
    length = F.length("text")
    starts = F.when(length <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), length - 1, F.lit(step)))
    cut = joined.select(owner, F.posexplode(F.transform(starts, lambda s: F.substring("text", s + 1, F.lit(size)))).alias("window", "content"))
    return cut.where(F.trim("content") != "")


def window_sources(chunks: DataFrame, owner: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """owner, window, pos: the chunks that each window of ``fixed_windows`` touches, the space before a chunk counted with
    it. Windows and chunks meet by places alone, so no text is carried: chunk and window are each a range of characters.
    Of windows of two characters and more none is blank."""
    if size < 2:
        raise ValueError("windows of one character can be blank")
    step = max(size - overlap, 1)
    held = _lengths(chunks, owner).select(owner, "pos", "low", (F.col("low") + F.length("c")).alias("high"))
    total = F.max("high").over(Window.partitionBy(owner))
    first = F.greatest(F.ceil((F.col("low") - F.when(F.col("low") > 0, 1).otherwise(0) - size + 1) / F.lit(step)), F.lit(0))
    last = F.when(F.col("_t") <= size, 0).otherwise(F.floor((F.col("high") - 1) / F.lit(step)))
    ranged = held.withColumn("_t", total).select(owner, "pos", first.cast("int").alias("a"), last.cast("int").alias("b")).where("a <= b")
    return ranged.select(owner, F.explode(F.sequence("a", "b")).alias("window"), "pos")


def pack(chunks: DataFrame, owner: str, target: int = 512, overlap: int = 1) -> DataFrame:
    """Neighbouring chunks of an owner merged up to ``target`` characters, ``overlap`` chunks carried on. A chunk
    of target or more stands alone, uncut; the carried chunk counts, and may take a pack over the target.
    A fold over the owner's lengths only: the texts are joined by the packs' positions afterwards."""
    lengths = chunks.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("pos", F.length("content").alias("n")))).alias("x"))
    empty = F.array().cast("array<struct<pos:int,n:int>>")
    held = "struct<out:array<array<struct<pos:int,n:int>>>,buf:array<struct<pos:int,n:int>>>"

    def size_of(buf):
        return F.aggregate(buf, F.lit(0), lambda t, c: t + c["n"])

    def flushed(acc):
        return F.when(F.size(acc["buf"]) > 0, F.concat(acc["out"], F.array(acc["buf"]))).otherwise(acc["out"])

    def step(acc, c):
        big = F.struct(F.concat(flushed(acc), F.array(F.array(c))).alias("out"), empty.alias("buf"))
        full = (F.size(acc["buf"]) > 0) & (size_of(acc["buf"]) + c["n"] > target)
        carried = F.when(F.lit(overlap) > 0, F.slice(acc["buf"], F.greatest(F.lit(1), F.size(acc["buf"]) - overlap + 1), F.lit(max(overlap, 1)))).otherwise(empty)
        over = F.struct(flushed(acc).alias("out"), F.concat(carried, F.array(c)).alias("buf"))
        more = F.struct(acc["out"].alias("out"), F.concat(acc["buf"], F.array(c)).alias("buf"))
        return F.when(c["n"] >= target, big).when(full, over).otherwise(more)

    packs = F.aggregate("x", F.struct(F.array().cast("array<array<struct<pos:int,n:int>>>").alias("out"), empty.alias("buf")).cast(held), step, flushed)
    rows = lengths.select(owner, F.posexplode(packs).alias("pack", "held"))
    flat = rows.select(owner, "pack", F.posexplode("held").alias("k", "c")).select(owner, "pack", "k", F.col("c.pos").alias("pos"))
    return flat.join(chunks.select(owner, "pos", "content"), [owner, "pos"]).groupBy(owner, "pack").agg(
        F.array_sort(F.collect_list(F.struct("k", "pos", "content"))).alias("y")
    ).select(
        owner, "pack", F.transform("y", lambda c: c["pos"]).alias("base"), F.size("y").alias("n_base"),
        F.array_join(F.transform("y", lambda c: c["content"]), "\n").alias("content"),
        F.aggregate("y", F.lit(0), lambda t, c: t + F.length(c["content"])).alias("n_chars"),
    )
