"""A corpus pipeline: each stage is one operator of loomspark.llm, written as Parquet and read by the next.

Toxic documents go; one document of each group of near copies stays; passages that repeat across what is
left are cut out; the rest is packed into training windows. All stages but the last keep the columns of
``documents``. Defined results: null texts pass every filter and are packed as the end id alone; rows with
a null doc_id are kept; of rows equal in all columns one stays, and rows that share only a doc_id are told
apart; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import minhash, packing, suffix_dedup, toxicity
from loomspark.llm.common import free_names, read_table, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes from which a repeated passage is cut out.
PASSAGE_BYTES = 240


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by doc_id, those of a doc_id that stands more than once by numbers of their own."""
    row = free_names(docs, "_row")[0]
    rows = docs.withColumn(row, F.col("doc_id"))
    repeated = stored(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        top = docs.agg(F.max("doc_id")).first()[0]
        several = docs.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates()
        several = stored(several.withColumn(row, F.monotonically_increasing_id() + F.lit(top + 1)), "repeated_rows")
        rows = rows.join(repeated, "doc_id", "left_anti").select(*rows.columns).unionByName(several)
    groups = stored(minhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select("doc_id", "kept"), "groups")
    gone = groups.where("not kept and doc_id is not null").select(F.col("doc_id").alias(row))
    gone = F.broadcast(gone) if gone.count() <= minhash.BROADCAST_ROWS else gone
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.deduplicated(docs, PASSAGE_BYTES)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("repeats", cut_repeats), ("packing", pack)]

#: No SQL expresses the models and suffix structures; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
