"""Windowed counts of events, in batch and as a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total"
    )


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, session_start, session_end (the last event), n."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("session_end")).select(
        "user_id", F.col("w.start").alias("session_start"), "session_end", "n"
    )


def stream_tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The streaming form: state is dropped once the watermark has passed a window."""
    return tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), width)
