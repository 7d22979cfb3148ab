"""Capability envelopes of sessions: what a user touches without a long pause, as a stream and as a batch.

Timestamps without zone are taken as UTC. Null users or times are left out; equal events count once each. Streams drop
events later than the watermark; an empty stream gives no session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_envelopes(events: DataFrame, gap_hours: int = 12) -> DataFrame:
    """``user_id, session_no, started, n_events, kinds`` by pauses of gap_hours or more (batch)."""
    rows = events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pause = F.col("ts") - F.lag("ts").over(w) >= F.expr(f"INTERVAL '{gap_hours}' HOUR")
    marked = rows.withColumn("new", F.when(pause, 1).otherwise(0)).withColumn("session_no", F.sum("new").over(w))
    return marked.groupBy("user_id", "session_no").agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n_events"), F.array_sort(F.collect_set("event_type")).alias("kinds"))


def streaming_envelopes(events: DataFrame, gap_hours: int = 12, late_hours: int = 24) -> DataFrame:
    """The same as a streaming aggregation over session windows with a watermark."""
    rows = events.where(F.col("user_id").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp"))
    marked = rows.withWatermark("ts", f"{late_hours} hours")
    grouped = marked.groupBy("user_id", F.session_window("ts", f"{gap_hours} hours"))
    return grouped.agg(F.count(F.lit(1)).alias("n_events"), F.array_sort(F.collect_set("event_type")).alias("kinds")).select("user_id", F.col("session_window.start").alias("started"), "n_events", "kinds")
