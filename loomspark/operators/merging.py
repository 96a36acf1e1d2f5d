"""Merging records of several sources: equivalence, conflicts, votes and resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.encoding import encode_literal
from loomspark.sources.tables import CELLS_A_TASK, parts_of

CELL = ["entity_id", "dim"]
DEGENERATE = ("EMPTY_SLOT", "NONE", "NOT_APPLICABLE")
VALUELESS = ("EMPTY_SLOT", "NONE", "NOT_APPLICABLE", "UNKNOWN", "INFINITE")


def equivalent(a: Column, b: Column) -> Column:
    """Do two encoded literals mean the same? Unknown is not empty, and a condition without a base is like nothing but itself."""
    av, bv, ac, bc = a["value"], b["value"], a["category"], b["category"]

    def is_pair(x: str, y: str) -> Column:
        return ((ac == x) & (bc == y)) | ((ac == y) & (bc == x))

    one_sided = F.when(av.isNull(), ac.isin(*DEGENERATE)).otherwise(bc.isin(*DEGENERATE))
    return (
        F.when(av.isNotNull() & bv.isNotNull(), av == bv)
        .when(av.isNotNull() | bv.isNotNull(), one_sided)
        .when(ac == bc, True)
        .when(is_pair("UNKNOWN", "EMPTY_SLOT") | (ac == "CONDITIONAL_NO_BASE") | (bc == "CONDITIONAL_NO_BASE"), False)
        .otherwise(ac.isin(*VALUELESS) & bc.isin(*VALUELESS))
    )


def conflict_type(a: Column, b: Column) -> Column:
    def absent(x: Column) -> Column:
        return x["value"].isNull() & (x["category"] != "UNKNOWN")

    return F.when(absent(a) | absent(b), "MISSING_IN_ONE").when(a["category"] != b["category"], "CATEGORY_DIFF").otherwise("VALUE_MISMATCH")


def three_source_merge(primary: DataFrame, mirrors: dict[str, DataFrame]) -> DataFrame:
    """All frames: entity_id, dim, raw (first row of a key wins upstream). One row for each mirror's cell
    that differs from the primary's: event CONFLICT (with its type) or NORMALISED. Cells a mirror does not
    provide are skipped. The mirrors are stacked, so the primary is shuffled once for all of them."""
    stacked = None
    for source, mirror in mirrors.items():
        rows = mirror.select("entity_id", "dim", F.col("raw").alias("raw_b"), F.lit(source).alias("source_b"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    parts = parts_of(stacked, CELLS_A_TASK)
    met = primary.select("entity_id", "dim", F.col("raw").alias("raw_a")).repartition(parts, *CELL).join(stacked.repartition(parts, *CELL), CELL)
    coded = met.where("raw_a <> raw_b").withColumn("a", encode_literal(F.col("raw_a"))).withColumn("b", encode_literal(F.col("raw_b")))
    kept = coded.where((F.col("b")["category"] != "NOT_APPLICABLE") & (F.col("a")["category"] != "NOT_APPLICABLE"))
    same = equivalent(F.col("a"), F.col("b"))
    return kept.select(
        "entity_id", "dim", "raw_a", "raw_b", "source_b",
        F.when(same, "NORMALISED").otherwise("CONFLICT").alias("event"),
        F.when(~same, conflict_type(F.col("a"), F.col("b"))).alias("conflict_type"),
    )


def mirror_independence(a: DataFrame, b: DataFrame, least: int = 3) -> DataFrame:
    """entity_id, dim, raw of two mirrors. A mirror whose every difference is a gap in the other copied it;
    otherwise ``least`` real differences of grade make them independent."""
    def grade(x: Column) -> Column:
        low = F.lower(F.trim(x))
        return F.when(low.isin("a", "b", "c", "d", "e"), F.upper(low)).when(low.isin("infinite", "infi", "∞"), "∞").when(low.isin("unknown", "situational", "?"), "?")

    parts = parts_of(a, CELLS_A_TASK)
    trimmed = lambda df, name: df.select("entity_id", "dim", F.trim(F.coalesce("raw", F.lit(""))).alias(name)).repartition(parts, *CELL)
    met = trimmed(a, "x").join(trimmed(b, "y"), CELL)
    x, y = F.col("x"), F.col("y")
    counts = met.agg(
        F.count_if(x == y).alias("same_cells"), F.count_if((x != "") & (y == "")).alias("only_a"), F.count_if((x == "") & (y != "")).alias("only_b"),
        F.count_if((x != "") & (y != "") & (grade(x) != grade(y))).alias("real_diff"),
    )
    subset = (F.col("only_b") == 0) & (F.col("only_a") > 0)
    return counts.withColumn("b_is_subset", subset).withColumn("independent", ~subset & (F.col("real_diff") >= least))


def resolve(conflicts: DataFrame, mirrors: list[str], independent: Column, use_consensus: bool = True) -> DataFrame:
    """conflicts: entity_id, dim, raw_a, raw_b, source_b, conflict_type. One resolution for each entity_id
    and dim: strategy, resolved_raw, confidence and whether another policy would turn it (fragile)."""
    votes = conflicts.groupBy("entity_id", "dim", "raw_b").agg(F.count_distinct(F.when(F.col("source_b").isin(*mirrors), F.col("source_b"))).alias("n"))
    agreed = votes.groupBy("entity_id", "dim").agg(F.min(F.when(F.col("n") >= 2, F.col("raw_b"))).alias("agreed"))
    first = conflicts.groupBy("entity_id", "dim").agg(F.min(F.struct("source_b", "raw_a", "raw_b", "conflict_type")).alias("r")).select("entity_id", "dim", "r.*")
    kind, a, b, both = F.col("conflict_type"), F.col("raw_a"), F.col("raw_b"), F.col("agreed").isNotNull()
    usable = both & independent & F.lit(use_consensus)
    has_a, has_b = ~a.isin("", "None"), ~b.isin("", "None")

    def made(strategy: str, raw: Column, confidence: float, fragile: bool) -> Column:
        return F.struct(F.lit(strategy).alias("strategy"), raw.alias("resolved_raw"), F.lit(confidence).alias("confidence"), F.lit(fragile).alias("fragile"))

    outcome = (
        F.when(kind == "DUPLICATE_IN_SOURCE", made("split_by_form", a, 0.95, False))
        .when((kind == "MISSING_IN_ONE") & has_b & ~has_a, made("prefer_primary", b, 0.85, False))
        .when((kind == "MISSING_IN_ONE") & has_a & ~has_b, made("prefer_primary", a, 0.85, False))
        .when(kind == "MISSING_IN_ONE", made("keep_unknown", a, 0.85, False))
        .when((kind == "CATEGORY_DIFF") & (a == "?"), made("keep_unknown", a, 0.6, True))
        .when(kind == "CATEGORY_DIFF", made("prefer_primary", a, 0.75, True))
        .when(usable, made("prefer_consensus", F.col("agreed"), 0.95, False))
        .when(both & F.lit(use_consensus), made("prefer_primary", a, 0.8, True))
        .otherwise(made("prefer_primary", a, 0.75, True))
    )
    return first.join(agreed, ["entity_id", "dim"]).withColumn("o", outcome).select("entity_id", "dim", "conflict_type", "o.*")


def bias(primary: DataFrame, mirror: DataFrame, least: int = 5) -> DataFrame:
    """Per dim: how grades of a mirror stand above or below the primary's, and whether that leans one way."""
    a = primary.select("entity_id", "dim", encode_literal(F.col("raw")).alias("x")).where("x.category = 'RANKED'").select("entity_id", "dim", F.col("x.value").alias("a"))
    b = mirror.select("entity_id", "dim", encode_literal(F.col("raw")).alias("x")).where("x.category = 'RANKED'").select("entity_id", "dim", F.col("x.value").alias("b"))
    diff = F.col("b") - F.col("a")
    out = a.join(b, ["entity_id", "dim"]).groupBy("dim").agg(F.count_if(diff > 0).alias("higher"), F.count_if(diff < 0).alias("lower"), F.count_if(diff == 0).alias("equal"), F.sum(diff).cast("long").alias("total"))
    odd = F.col("higher") + F.col("lower")
    strength = F.when(odd > 0, F.round(F.col("total") / odd, 3)).otherwise(0.0)
    verdict = F.when(odd == 0, "none").when(odd < least, "too_few").when(strength >= 0.8, "high").when(strength <= -0.8, "low").otherwise("balanced")
    return out.withColumn("strength", strength).withColumn("verdict", verdict)
