"""Relational shapes: ranking, latest per key, range joins, upserts and the like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_off_scale(df: DataFrame, category: str, value: str, name: str, n: int) -> DataFrame:
    """The n highest: what is off the scale (INFINITE) first, then by value; rows with neither do not rank."""
    infinite = F.col(category) == "INFINITE"
    return df.where(infinite | F.col(value).isNotNull()).orderBy(infinite.desc_nulls_last(), F.col(value).desc_nulls_last(), F.col(name).asc_nulls_last()).limit(n)


def extremes(df: DataFrame, category: str, value: str, highest: bool = True) -> DataFrame:
    """Every row that ties for the extreme. The highest prefers INFINITE; the lowest leaves it out."""
    if highest:
        infinite = F.coalesce(F.col(category) == "INFINITE", F.lit(False))
        key = F.when(infinite, F.lit(1e9)).otherwise(F.col(value).cast("double"))
        best = df.agg(F.max(key).alias("best"))
    else:
        key = F.when(F.coalesce(F.col(category) != "INFINITE", F.lit(True)), F.col(value).cast("double"))
        best = df.agg(F.min(key).alias("best"))
    return df.withColumn("_key", key).join(F.broadcast(best), F.col("_key") == F.col("best")).drop("_key", "best")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those with their keys, and the others of new; keys match null-safely, one row each."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    return latest(both, keys, F.col("_age")).drop("_age")


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose keys it has not; what stands is never overwritten."""
    o, n = old.select(*(F.col(k).alias(f"_{k}") for k in keys)), new
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return old.unionByName(n.join(o, same, "left_anti"))


def prune(df: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    return df.join(keep.select(key), key, "left_semi")


def range_join(points: DataFrame, spans: DataFrame, group: str, at: str, low: str, high: str, width: int) -> DataFrame:
    """Points within spans (ends included) of their group. Spans are cut at multiples of ``width``, so the
    join is an equality on (group, bucket) with a filter; a point meets each span once."""
    cut = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("_bucket", F.floor(F.col(at) / width)).join(cut, [group, "_bucket"]).where(F.col(at).between(F.col(low), F.col(high))).drop("_bucket")


def nearest_rank(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The element at floor(n * share) (from 0, the last at most) of each group's sorted values."""
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    counted = df.groupBy(*groups, value).agg(F.count("*").alias("_c"))
    placed = counted.withColumn("_upto", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    picks = [F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("_n") * F.lit(share)), F.col("_n") - 1), F.col(value))).alias(name) for name, share in shares.items()]
    return placed.groupBy(*groups).agg(F.max("_n").alias("n"), *picks)


def compare_pair(long: DataFrame, entity: str, left, right, least_common: int = 3) -> DataFrame:
    """One row: wins of either side and ties over the dimensions both have, and the verdict."""
    a = long.where(F.col(entity) == left).select("dim", F.col("value").alias("a"))
    b = long.where(F.col(entity) == right).select("dim", F.col("value").alias("b"))
    met = a.join(b, "dim").where("a is not null and b is not null")
    out = met.agg(F.count("*").alias("n_common"), F.count_if(F.col("a") > F.col("b")).alias("left_wins"), F.count_if(F.col("a") < F.col("b")).alias("right_wins"))
    verdict = F.when(F.col("n_common") < least_common, "too_few").when(F.col("left_wins") > F.col("right_wins"), "left").when(F.col("left_wins") < F.col("right_wins"), "right").otherwise("even")
    return out.withColumn("verdict", verdict)
