"""Gap sessions over an unbounded source of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, gap: str, late: str, key: str = "user_id", time: str = "ts") -> DataFrame:
    """``(key, start, end, events)`` of sessions that a gap of silence ends; state is dropped ``late`` after the watermark."""
    held = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return held.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
