"""Streams of events: windowed counts, gap sessions and the last messages of each session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST = 20
IDLE_MS = 3_600_000


def audit_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per type and window; rows later than ``late`` are dropped."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))


def gap_sessions(events: DataFrame, gap: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))


def session_messages(events: DataFrame, most: int = MOST, idle_ms: int = IDLE_MS, late: str = "10 minutes") -> DataFrame:
    """(user_id, kept, seen, closed) of each session that a batch changed.

    The state is the last ``most`` event ids and how many there were.  An event
    of type ``clear`` empties it; when the watermark passes the last event by
    ``idle_ms`` the session is given out once more as closed and forgotten.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, seen, last = state.get if state.exists else ([], 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "kept": [len(kept)], "seen": [seen], "closed": [True]})
            return
        kept = list(kept)
        for rows in frames:
            for r in rows.sort_values("event_id").itertuples(index=False):
                seen += 1
                last = max(last, int(r.ms))
                kept = [] if r.event_type == "clear" else [*kept, int(r.event_id)][-most:]
        state.update((kept, seen, last))
        state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "kept": [len(kept)], "seen": [seen], "closed": [False]})

    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    own = own.select("user_id", "event_id", "event_type", "ts", F.unix_millis("ts").alias("ms"))
    return own.groupBy("user_id").applyInPandasWithState(step, "user_id long, kept int, seen long, closed boolean", "kept array<long>, seen long, last long", "update", GroupStateTimeout.EventTimeTimeout)
