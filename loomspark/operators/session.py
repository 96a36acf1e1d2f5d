"""Sessions: turns of one user with no gap above a limit, and what later turns inherit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_SECONDS = 1800


def sessions(df: DataFrame, user: str, seconds: Column, tie: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """Adds session (from 1 for each user) and turn (from 1 in each session)."""
    w = Window.partitionBy(user).orderBy("_s", tie)
    timed = df.withColumn("_s", seconds)
    new = F.coalesce(F.col("_s") - F.lag("_s").over(w) > ttl, F.lit(True)).cast("int")
    numbered = timed.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return numbered.withColumn("turn", F.row_number().over(Window.partitionBy(user, "session").orderBy("_s", tie)).cast("int")).drop("_s", "_new")


def inherit(df: DataFrame, session: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Fills each column with its last known value earlier in the session, as *_context."""
    w = Window.partitionBy(*session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"{c}_context": F.last(c, ignorenulls=True).over(w) for c in columns})
