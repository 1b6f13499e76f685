"""Progress events: batch views. The streaming twins are in corpuslens.streaming.progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.numbering import neighbour_on, offsets_on, ranged

TTL_SECONDS = 3600


def latest_status(events: DataFrame) -> DataFrame:
    """Current status per analysis: the event that arrived last. Combines on the map side."""
    return (
        events.groupBy("analysis_id")
        .agg(F.max(F.struct("ts", "event_id", "status", "progress_percent", "error_message")).alias("_e"))
        .select("analysis_id", "_e.status", "_e.progress_percent", "_e.error_message", "_e.ts")
    )


def session_state(has_complete: Column, has_failed: Column) -> Column:
    """How a progress list ended: a list that fell silent without an ending is stalled."""
    return F.when(has_complete, "complete").when(has_failed, "failed").otherwise("stalled")


def progress_sessions(events: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Lists kept alive by each push and dropped ttl seconds after the last one.

    A push that comes ttl seconds or more after the one before starts a new list. Neighbours and list
    numbers come from range partitions, so one very busy analysis is spread over many tasks.
    """
    group, order = ["analysis_id"], ["ts", "event_id"]
    events = events.select("analysis_id", "event_id", "ts", "status", "progress_percent")
    rows = neighbour_on(ranged(events, group, order), group, order, "ts", "_before", -1)
    gap = F.col("ts") >= F.col("_before") + F.make_dt_interval(secs=F.lit(ttl_seconds))
    rows = rows.withColumn("_opens", F.when(gap, 1).otherwise(0))
    listed = offsets_on(rows, group, order, "_opens", "_list").withColumn("_list", F.col("_list") + F.col("_opens"))
    return (
        listed.groupBy("analysis_id", "_list")
        .agg(
            F.min("ts").alias("session_start"),
            F.max("ts").alias("_last"),
            F.count("*").alias("events"),
            F.max("progress_percent").alias("max_percent"),
            F.bool_or(F.col("progress_percent") >= 100).alias("_complete"),
            F.bool_or(F.col("status") == "failed").alias("_failed"),
        )
        .select(
            "analysis_id", "session_start",
            (F.col("_last") + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"),
            "events", "max_percent",
            session_state(F.col("_complete"), F.col("_failed")).alias("state"),
        )
    )


def stage_durations(events: DataFrame) -> DataFrame:
    """Seconds from each event to the next one of the same analysis; NULL for the last."""
    group, order = ["analysis_id"], ["ts", "event_id"]
    events = events.select("analysis_id", "event_id", "ts", "status", "progress_percent")
    rows = neighbour_on(ranged(events, group, order), group, order, "ts", "_next", 1)
    seconds = F.timestamp_diff("SECOND", F.col("ts"), F.col("_next"))
    return rows.select("analysis_id", "event_id", "status", "progress_percent", "ts", seconds.alias("seconds"))
