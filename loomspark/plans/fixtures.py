"""Derived inputs: cells, mirrors, intervals, questions made from the tables by rule, with the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.encoding import encode_literal
from loomspark.sources.tables import table

LITERALS = ["A", "B", "C", "D", "E", "None", "∅", "?", "∞", "B※20 m", "※Complete", "", "situational"]
_SQL_LITERALS = "[" + ", ".join(f"'{x}'" for x in LITERALS) + "]"


def _literal(index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, LITERALS)), (index % len(LITERALS) + 1).cast("int"))


def cells(spark: SparkSession, sf_dir: str, part: DataFrame | None = None) -> DataFrame:
    """entity_id, name, brand, dim, raw: six raw literals for each part."""
    part = (table(spark, sf_dir, "part") if part is None else part).select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return part.withColumn("dim", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("raw", _literal(F.col("entity_id") * 7 + F.col("dim") * 5))


def coded(spark: SparkSession, sf_dir: str, part: DataFrame | None = None) -> DataFrame:
    """cells with value, category and note."""
    x = cells(spark, sf_dir, part).withColumn("x", encode_literal(F.col("raw")))
    return x.select("entity_id", "name", "brand", "dim", "raw", "x.value", "x.category", "x.note")


def mirrors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Mirror a lacks some entities and shifts some literals; mirror b is a with gaps."""
    key = F.col("entity_id")
    shift = F.when((key + F.col("dim")) % 17 == 0, 1).otherwise(0)
    a = cells(spark, sf_dir).where(key % 10 != 3).withColumn("raw", _literal(key * 7 + F.col("dim") * 5 + shift)).select("entity_id", "dim", "raw")
    return a, a.withColumn("raw", F.when((key + F.col("dim")) % 5 == 0, "").otherwise(F.col("raw")))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 720).alias("pos"), (F.col("user_id") % 7).alias("grp"))


def intervals(spark: SparkSession) -> DataFrame:
    return spark.range(200).select(F.col("id").alias("span_id"), (F.col("id") % 7).alias("grp"), (F.col("id") * 5 % 700).alias("low"), (F.col("id") * 5 % 700 + 18).alias("high"))


CELLS_SQL = f"cells AS (SELECT p_partkey AS entity_id, p_name AS name, p_brand AS brand, CAST(d AS INTEGER) AS dim, list_extract({_SQL_LITERALS}, CAST((p_partkey * 7 + d * 5) % 13 + 1 AS INTEGER)) AS raw FROM part, range(6) t(d))"


def coded_sql(source: str, target: str) -> str:
    """A CTE that adds value and category to a relation with raw, for the derived literals."""
    return f"""{target} AS (SELECT *,
  CASE WHEN regexp_matches(raw, '^[A-E]※') THEN position(left(raw, 1) IN 'EDCBA') WHEN raw IN ('A','B','C','D','E') THEN position(raw IN 'EDCBA') WHEN raw = 'None' THEN 0 END::INTEGER AS value,
  CASE WHEN raw = '' THEN 'NOT_APPLICABLE' WHEN regexp_matches(raw, '^[A-E]※') THEN 'CONDITIONAL' WHEN raw LIKE '%※%' OR raw = 'situational' THEN 'CONDITIONAL_NO_BASE'
       WHEN raw IN ('A','B','C','D','E') THEN 'RANKED' WHEN raw = 'None' THEN 'NONE' WHEN raw = '∅' THEN 'EMPTY_SLOT' WHEN raw = '?' THEN 'UNKNOWN' WHEN raw = '∞' THEN 'INFINITE' ELSE 'UNPARSED' END AS category,
  CASE WHEN raw LIKE '%※%' THEN split_part(raw, '※', 2) WHEN raw = 'situational' THEN 'varies by context' END AS note
  FROM {source})"""


CODED_SQL = CELLS_SQL + ", " + coded_sql("cells", "coded")
MIRRORS_SQL = f"""mirror_a AS (SELECT entity_id, dim, list_extract({_SQL_LITERALS}, CAST((entity_id * 7 + dim * 5 + CASE WHEN (entity_id + dim) % 17 = 0 THEN 1 ELSE 0 END) % 13 + 1 AS INTEGER)) AS raw FROM cells WHERE entity_id % 10 <> 3),
mirror_b AS (SELECT entity_id, dim, CASE WHEN (entity_id + dim) % 5 = 0 THEN '' ELSE raw END AS raw FROM mirror_a)"""
POINTS_SQL = "points AS (SELECT event_id, user_id, event_id % 720 AS pos, user_id % 7 AS grp FROM events)"
INTERVALS_SQL = "spans AS (SELECT i AS span_id, i % 7 AS grp, i * 5 % 700 AS low, i * 5 % 700 + 18 AS high FROM range(200) t(i))"
