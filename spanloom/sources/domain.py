"""The transcript domain's relations, built from the driver's tables.

Times are integer milliseconds where exactness matters.  Each relation has the
DuckDB SQL of the same rows, for oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table

EPOCH_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))"


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """``(job, span_index, s, e)``: sorted, non-overlapping spans of each user's events."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("job"), "event_id", F.expr(f"{EPOCH_US} div 1000").alias("s"), F.round(F.col("value") * 1000).cast("long").alias("d"))
    w = Window.partitionBy("job").orderBy("s", "event_id")
    end = F.col("s") + F.col("d")
    cut = e.select("job", "s", F.least(end, F.coalesce(F.lead("s").over(w), end)).alias("e"), F.row_number().over(w).alias("n"))
    return cut.filter("e > s").select("job", (F.col("n") - 1).alias("span_index"), "s", "e")


SPANS = """spans AS (SELECT * FROM (SELECT user_id AS job, row_number() OVER w - 1 AS span_index, s, least(s + d, coalesce(lead(s) OVER w, s + d)) AS e
  FROM (SELECT user_id, event_id, epoch_us(ts) // 1000 AS s, round(value * 1000)::BIGINT AS d FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)) WHERE e > s)"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """``(job, frame, prob)``: speech probabilities, a frame for each event of a user."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.expr(EPOCH_US).alias("us"), "value")
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    return e.select(F.col("user_id").alias("job"), (F.row_number().over(w) - 1).alias("frame"), (F.least("value", F.lit(100.0)) / 100).alias("prob"))


FRAMES = "frames AS (SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, least(value, 100.0) / 100 AS prob FROM events)"


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """``(job, segment_index, text, start_ms, end_ms)``: conversation turns laid out in time."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("job"), F.col("turn").alias("segment_index"), "text", (F.length("text") * F.when(F.col("turn") % 3 == 1, 90).otherwise(60)).cast("long").alias("d"))
    before = Window.partitionBy("job").orderBy("segment_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("d") + 90000).over(before), F.lit(0))
    return c.select("job", "segment_index", "text", start.alias("start_ms"), (start + F.col("d")).alias("end_ms"))


SEGMENTS = """segments AS (SELECT job, segment_index, text, start_ms, start_ms + d AS end_ms FROM (SELECT *, coalesce(sum(d + 90000) OVER (PARTITION BY job ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms
  FROM (SELECT conv_id AS job, turn AS segment_index, text, (length(text) * CASE WHEN turn % 3 = 1 THEN 90 ELSE 60 END)::BIGINT AS d FROM conversations)))"""
