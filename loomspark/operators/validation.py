"""Validation rules over entities, encoded cells and chunks: rule, level, subject for each violation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.encoding import encode_literal

CATEGORIES = ("RANKED", "NONE", "EMPTY_SLOT", "UNKNOWN", "INFINITE", "CONDITIONAL", "CONDITIONAL_NO_BASE", "NOT_APPLICABLE", "UNPARSED")


def violations(df: DataFrame, subject: Column, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """rules: name -> (level, condition that must hold). One pass; a null condition is a violation."""
    broken = F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(level).alias("level"))) for name, (level, holds) in rules.items()))
    return df.select(subject.cast("string").alias("subject"), F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("x")).select("x.rule", "x.level", "subject")


def cell_rules() -> dict[str, tuple[str, Column]]:
    """For columns raw, value, category: recomputed equals stored, range, known category, and which categories carry a value."""
    again = encode_literal(F.col("raw"))
    valued = F.col("category").isin("RANKED", "NONE", "CONDITIONAL")
    return {
        "recomputed_value": ("ERROR", again["value"].eqNullSafe(F.col("value"))),
        "recomputed_category": ("ERROR", again["category"] == F.col("category")),
        "value_in_range": ("ERROR", F.col("value").isNull() | F.col("value").between(0, 5)),
        "known_category": ("ERROR", F.col("category").isin(*CATEGORIES)),
        "value_fits_category": ("ERROR", valued == F.col("value").isNotNull()),
        "parsed": ("WARN", F.col("category") != "UNPARSED"),
    }


def duplicates(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    subject = F.concat_ws("|", *keys)
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.lit("ERROR").alias("level"), subject.alias("subject"))


def dangling(df: DataFrame, key: str, known: DataFrame, known_key: str, rule: str) -> DataFrame:
    target = known.select(F.col(known_key).alias("_k"))
    return df.where(F.col(key).isNotNull()).join(target, F.col(key) == F.col("_k"), "left_anti").select(F.lit(rule).alias("rule"), F.lit("ERROR").alias("level"), F.col(key).cast("string").alias("subject"))


def all_rules(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
