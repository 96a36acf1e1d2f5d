"""Running totals and gapless numbers over a whole cluster, without a window that one task sorts.

Rows are dealt into buckets that follow the order asked for; a bucket is summed, the sums of 256 neighbouring
buckets are added up in one window, and so on upwards. No task orders more than a bucket or 256 sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.sources.storage import stored

#: Sums that meet in one window, as a power of two.
FAN_BITS = 8


def bucket_totals(rows: DataFrame, keys: list[str], bucket: str, bits: int, value: Column) -> DataFrame:
    """keys, bucket, before: the sum of ``value`` over the rows of the same keys in lower buckets. Buckets are
    numbers from 0 of at most ``bits`` bits. Keys must not be null."""
    return _before(rows.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum")), keys, bucket, bits)


def _before(sums: DataFrame, keys: list[str], bucket: str, bits: int) -> DataFrame:
    sums = sums.withColumn("_above", F.shiftright(bucket, FAN_BITS) if bits > FAN_BITS else F.lit(0).cast("long"))
    beside = Window.partitionBy(*keys, "_above").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    out = sums.withColumn("before", F.coalesce(F.sum("_sum").over(beside), F.lit(0)))
    if bits > FAN_BITS:
        above = sums.groupBy(*keys, "_above").agg(F.sum("_sum").alias("_sum")).withColumnRenamed("_above", bucket)
        above = _before(above, keys, bucket, bits - FAN_BITS).withColumnRenamed(bucket, "_above").withColumnRenamed("before", "_higher")
        out = out.join(above, [*keys, "_above"]).withColumn("before", F.col("before") + F.col("_higher"))
    return out.select(*keys, bucket, "before")


def running_total(rows: DataFrame, keys: list[str], bucket: str, bits: int, order: list, value: Column, name: str) -> DataFrame:
    """rows with ``name``: the sum of ``value`` over the rows of the same keys that come before. Rows are ordered
    by bucket and then by ``order``, which must tell rows apart wherever their values differ."""
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    out = held.join(bucket_totals(rows, keys, bucket, bits, value), [*keys, bucket])
    return out.withColumn(name, F.col("_inside") + F.col("before")).drop("_inside", "before")


def gapless_ids(rows: DataFrame, order: list, name: str = "id", first: int = 0) -> DataFrame:
    """rows with consecutive numbers in the order given: a range sort numbers each task's rows, and each task's
    number is raised by the rows of the tasks before. The sorted rows are written once, so that both steps see
    the same tasks. Rows that the order does not tell apart are numbered in either order."""
    local = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    local = stored(local, "numbered")
    task, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    tasks = local.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = _before(tasks.withColumnRenamed("_n", "_sum"), [], "_task", 31)
    return local.withColumn("_task", task).join(before, "_task").withColumn(name, F.col("before") + within + first).drop("_task", "before", "_at")
