"""Changes with an audit trail, and checks of tables against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_partition(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without any row of a key that new brings, and all rows of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def prune_unreferenced(df: DataFrame, key: str, keep: DataFrame, references: DataFrame) -> DataFrame:
    """Rows that are to be kept or that something refers to."""
    known = keep.select(key).unionByName(references.select(key)).where(F.col(key).isNotNull())
    return df.join(known.distinct(), key, "left_semi")


def apply_resolutions(conflicts: DataFrame, resolutions: DataFrame, key: str) -> DataFrame:
    """conflicts: key, resolved_value, resolved_by; resolutions: key, new_value. Rows a human resolved stay; the others
    take the new value. ``action`` is kept, updated or open; previous is what stood there."""
    human = F.coalesce(F.col("resolved_by") == "human", F.lit(False))
    changes = ~human & F.col("new_value").isNotNull()
    action = F.when(changes, "updated").when(human | F.col("resolved_value").isNotNull(), "kept").otherwise("open")
    both = conflicts.join(resolutions.select(key, "new_value"), key, "left")
    return both.select(key, F.when(changes, F.col("new_value")).otherwise(F.col("resolved_value")).alias("value"), F.col("resolved_value").alias("previous"), action.alias("action"))


def audit_log(applied: DataFrame, key: str) -> DataFrame:
    """Rows to append: one for each update that changes something."""
    return applied.where("action = 'updated' and not (value <=> previous)").select(key, F.col("previous").alias("old_value"), F.col("value").alias("new_value"))


def with_status(df: DataFrame, status: str, resolved: str) -> DataFrame:
    """The rows of a status: all, pending (nothing resolved) or resolved."""
    if status not in ("all", "pending", "resolved"):
        raise ValueError(f"unknown status {status}")
    return df if status == "all" else df.where(F.col(resolved).isNull() if status == "pending" else F.col(resolved).isNotNull())


def source_duplicates(df: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """Keys that stand more than once: EXACT if every raw value is the same, else DUPLICATE_IN_SOURCE."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(raw, F.lit(""))).alias("n_raw"), F.min(raw).alias("low"), F.max(raw).alias("high"))
    return counted.where("n > 1").withColumn("kind", F.when(F.col("n_raw") > 1, "DUPLICATE_IN_SOURCE").otherwise("EXACT"))


def evicted(sessions: DataFrame, user: str, seen: str, keep: int, now: Column | None = None, ttl: float | None = None) -> DataFrame:
    """The sessions that stay: not expired, and of those the ``keep`` seen last; only ``keep`` rows leave a task."""
    last = sessions.groupBy(user).agg(F.max(seen).alias("last_seen"))
    if now is not None and ttl is not None:
        last = last.where(now - F.col("last_seen") <= ttl)
    return last.orderBy(F.col("last_seen").desc(), F.col(user)).limit(keep)


def name_quality(names: DataFrame, others: DataFrame, most: int = 3) -> DataFrame:
    """names: entity_id, name. Entities with over ``most`` names lose them all; a name of another kind goes."""
    counts = names.groupBy("entity_id").agg(F.count_distinct("name").alias("n")).where(F.col("n") <= most)
    return names.distinct().join(counts.select("entity_id"), "entity_id", "left_semi").join(others.select("name").distinct(), "name", "left_anti")


def gate(found: DataFrame, expected: dict[str, float], tolerance: float = 0.0) -> DataFrame:
    """found: metric, value. One row for each expected metric: value, expected, ok; a missing metric is not ok."""
    spark = found.sparkSession
    want = spark.createDataFrame([(k, float(v)) for k, v in expected.items()], "metric string, expected double")
    ok = F.coalesce(F.abs(F.col("value") - F.col("expected")) <= tolerance, F.lit(False))
    return F.broadcast(want).join(found, "metric", "left").select("metric", F.col("value").cast("double").alias("value"), "expected", ok.alias("ok"))


def named_in(candidates: DataFrame, name: str, text: str) -> DataFrame:
    """Candidates whose text has their name between word bounds."""
    runs = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^\\p{L}\\p{N}]+", " ")), F.lit(" "))
    return candidates.withColumn("verified", F.contains(runs(F.col(text)), runs(F.col(name))) & (F.trim(runs(F.col(name))) != ""))


def mutual(pages: DataFrame, name: str, key: str, points_at: str) -> DataFrame:
    """Pairs of pages of one name of which each says that it is not the other."""
    a = pages.select(name, F.col(key).alias("low"), F.col(points_at).alias("_says"))
    b = pages.select(name, F.col(key).alias("high"), F.col(points_at).alias("_says_too"))
    return a.join(b, (a[name] == b[name]) & (F.col("_says") == F.col("high")) & (F.col("_says_too") == F.col("low"))).where("low < high").select(a[name], "low", "high")


def utilisation(answers: DataFrame, least: float = 0.2) -> DataFrame:
    """answers: query_id, answer_words, evidence_words (arrays). Share of an evidence's distinct words that the
    answer uses, mean over evidence that has words, and how many are used (share of at least ``least``)."""
    e = F.array_distinct("evidence_words")
    share = F.when(F.size(e) > 0, F.size(F.array_intersect(e, F.col("answer_words"))) / F.size(e))
    return answers.withColumn("_s", share).groupBy("query_id").agg(F.count("*").alias("n_evidence"), F.round(F.coalesce(F.avg("_s"), F.lit(0.0)), 4).alias("ratio"), F.count_if(F.col("_s") >= least).alias("n_used"))


def first_seen_ranks(ranked: DataFrame, query: str, rank: str, entity: str) -> DataFrame:
    """A ranking of entities from a ranking of their chunks: each at its first place, places without gaps."""
    first = ranked.groupBy(query, entity).agg(F.min(rank).alias("_first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("_first", entity))).drop("_first")
