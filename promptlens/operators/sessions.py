"""Sessions of messages as tables: rows (session_id, role, content, ts) in, views over them out.

A stream of the same rows is kept by ``streaming.sessions``; here each view is
one grouped pass.  ``now`` is a parameter, so that a run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 20
IDLE_SECONDS = 3600
HEADER = "Previous conversation context:"


def _seconds(later: Column, earlier: Column) -> Column:
    return later.cast("timestamp").cast("double") - earlier.cast("timestamp").cast("double")


def age_seconds(now: Column, ts: Column) -> Column:
    return _seconds(now, ts)


def created(n: int, spark) -> DataFrame:
    """``n`` new sessions, each with an id of its own."""
    return spark.range(n).select(F.uuid().alias("session_id"), F.current_timestamp().alias("created_at"))


def kept(messages: DataFrame, most: int = MOST) -> DataFrame:
    """The last ``most`` messages of each session, with n, their place from the end; the window's limit acts in each task before its shuffle."""
    order = [F.desc("ts"), F.desc("turn")] if "turn" in messages.columns else [F.desc("ts")]
    return messages.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))).where(F.col("n") <= most)


def add_messages(sessions: DataFrame, held: DataFrame, new: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The messages after ``new`` ones came in, ``most`` of each session, and those refused as their session is unknown."""
    known = new.join(sessions.select("session_id"), "session_id", "left_semi")
    refused = new.join(sessions.select("session_id"), "session_id", "left_anti")
    return kept(held.unionByName(known), most).drop("n"), refused


def line(role: Column, content: Column) -> Column:
    """``User: ...``; every other role speaks as the assistant."""
    return F.concat(F.when(role == "user", "User").otherwise("Assistant"), F.lit(": "), content)


def session_records(messages: DataFrame, most: int = MOST) -> DataFrame:
    """One record of each session: messages (role, content, timestamp, in order), message_count, created_at, last_access.  A session's messages are bounded by ``most``."""
    own = kept(messages, most)
    first = messages.groupBy("session_id").agg(F.min("ts").alias("created_at"))
    item = F.struct((-F.col("n")).alias("o"), "role", "content", F.col("ts").alias("timestamp"))
    rows = own.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("o")).alias("messages"), F.count(F.lit(1)).alias("message_count"), F.max("ts").alias("last_access"))
    return rows.join(first, "session_id")


def last_messages(record: Column, limit: int | None = None) -> Column:
    """The last ``limit`` messages of a record's list; none or 0 means all."""
    return F.slice(record, F.greatest(F.size(record) - limit + 1, F.lit(1)), limit) if limit else record


def formatted(record: Column, limit: int | None = None) -> Column:
    """``Role: content`` lines of a record's messages."""
    return F.array_join(F.transform(last_messages(record, limit), lambda m: line(m["role"], m["content"])), "\n")


def for_context(record: Column, most: int = 5) -> Column:
    """The lines of the last messages under their header; empty without any."""
    return F.when(F.size(record) > 0, F.concat(F.lit(HEADER + "\n"), formatted(record, most))).otherwise("")


def with_idle(records: DataFrame, now: Column) -> DataFrame:
    return records.withColumn("inactive_seconds", _seconds(now, F.col("last_access")))


def alive(records: DataFrame, now: Column, idle: int = IDLE_SECONDS) -> DataFrame:
    """Sessions with an access within ``idle`` seconds."""
    return records.where(_seconds(now, F.col("last_access")) <= idle)


def expired(records: DataFrame, now: Column, idle: int = IDLE_SECONDS) -> DataFrame:
    return records.where(_seconds(now, F.col("last_access")) > idle)


def get(records: DataFrame, session_id: str) -> DataFrame:
    """The session's record: one row, or none."""
    return records.where(F.col("session_id") == session_id)


def deleted(records: DataFrame, ids: DataFrame) -> DataFrame:
    """What is left without the sessions of ``ids``."""
    return records.join(ids.select("session_id"), "session_id", "left_anti")


def cleared(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records with the messages of the sessions of ``ids`` gone."""
    marked = records.join(ids.select("session_id").distinct().withColumn("_clear", F.lit(True)), "session_id", "left")
    empty = F.slice("messages", 1, 0)
    return marked.withColumns({"messages": F.when(F.col("_clear"), empty).otherwise(F.col("messages")), "message_count": F.when(F.col("_clear"), 0).otherwise(F.col("message_count"))}).drop("_clear")


def listed(records: DataFrame) -> DataFrame:
    return records.select("session_id", "message_count", "created_at", "last_access")


def stats(records: DataFrame) -> DataFrame:
    """One row: sessions, messages, their mean, and when the oldest and newest began."""
    return records.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("messages"), F.coalesce(F.round(F.avg("message_count"), 2), F.lit(0.0)).alias("mean"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))
