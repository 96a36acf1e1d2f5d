"""The session store as a stream: windows with a gap, and a keyed state with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspark.operators.session import TTL_SECONDS


def session_counts(stream: DataFrame, user: str = "user_id", time: str = "ts", ttl: int = TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Events of each session window; a session is given out once the watermark has passed its end."""
    window = F.session_window(F.col(time), f"{ttl} seconds")
    return stream.withWatermark(time, late).groupBy(window.alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def last_entity(stream: DataFrame, user: str = "user_id", time: str = "ts", entity: str = "entity", ttl: int = TTL_SECONDS) -> DataFrame:
    """For each row, the entity it names or else the last one its user named within ``ttl`` seconds.
    The state of a user is (entity, time), dropped when it has not been touched for that long."""
    rows = stream.select(F.col(user).alias("user_id"), F.col(time).alias("ts"), F.col(entity).alias("entity")).withWatermark("ts", "10 minutes")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, at = state.get if state.exists else (None, None)
        latest = None
        for frame in frames:
            out = []
            for row in frame.sort_values("ts").itertuples():
                now = row.ts.timestamp()
                if at is not None and now - at > ttl:
                    known = None
                known, at = (row.entity if row.entity is not None else known), now
                latest = max(latest or now, now)
                out.append((key[0], row.ts, row.entity, known))
            yield pd.DataFrame(out, columns=["user_id", "ts", "entity", "context"])
        state.update((known, at))
        if latest is not None:
            state.setTimeoutTimestamp(max(int((latest + ttl) * 1000), state.getCurrentWatermarkMs() + 1))

    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, ts timestamp, entity string, context string", "entity string, at double", "append", GroupStateTimeout.EventTimeTimeout)
