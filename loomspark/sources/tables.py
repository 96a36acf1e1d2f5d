"""Scans. Schemas are given where a format does not carry them; a missing optional file is an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

#: Rows (not bytes) up to which a small side is broadcast by hint; above it the planner decides.
BROADCAST_ROWS = 200_000
#: Rows of a task where tables are dealt out by their number and not by their bytes.
ROWS_A_TASK = 100_000
#: The same for cells, which are short.
CELLS_A_TASK = 400_000
#: Arrow batches are held whole by a Python worker, beside what is made of them; smaller settings of the user's stay.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def bounded_batches(spark: SparkSession) -> None:
    for name, most in BATCH.items():
        given = str(spark.conf.get(name)).lower().removesuffix("b")
        if not given.isdigit() or not 0 < int(given) <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``limit`` rows (counted, not assumed)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def sized(df: DataFrame) -> DataFrame:
    """df as the side of a join: broadcast if it is ``small``, else met by sorting. Above the limit nothing is left to the
    planner, which goes by the bytes of files, of which made columns and exploded rows are many times as large."""
    few = df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(df) if few else df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores if its files give fewer (one small file is one task);
    inputs of many splits stay where they are. Only the plan is looked at."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str, rows: int = ROWS_A_TASK) -> DataFrame:
    """df in tasks of about ``rows`` rows, by the keys if there are any. Made columns shrink in a shuffle to a fraction of
    what they take in memory, so the planner, which merges partitions by their bytes, would leave whole tables to one task,
    as it would with a file of one row group. Frames of the same number of rows or ``parts`` meet without a further shuffle."""
    return df.repartition(parts_of(df, rows), *keys)


def parts_of(df: DataFrame, rows: int = ROWS_A_TASK) -> int:
    """So many tasks for df; of a table that is read whole the count is in the files' footers."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def json_scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON file of one array (or one object a line); nothing there gives no rows."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def csv_scan(spark: SparkSession, path: str, names: list[str], encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """Columns by position, whatever the header says. The first encoding that decodes the file without
    replacement characters is taken; a byte order mark is dropped with the header."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    for encoding in encodings:
        rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("encoding", encoding).csv(path)
        broken = F.lit(False)
        for n in names:
            broken = broken | F.coalesce(F.contains(F.col(n), F.lit("�")), F.lit(False))
        if encoding == encodings[-1] or rows.where(broken).isEmpty():
            return rows
    raise ValueError("no encoding given")


def union_scan(*frames: DataFrame) -> DataFrame:
    """Bag union by name; a column that one side lacks is null there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
