"""The profile of a run, observed while its rows are written.

The metrics are those of the stage that writes: Spark counts each partition of
it once, whatever is tried again, so they agree with what is written.  All of
them have a fixed size.  What grows with a run, its batches and recordings,
stays a relation over the written rows.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from . import stats

#: Kinds of segments whose lengths are told apart: all of them, and those that this run recognised.
KINDS = ("all", "inferred")
WHOLE = ("segments", "inferred_segments", "restored_segments", "errors", "batches", "batch_rows", "valid_frames", "padded_frames", "memory_failures", "least_batch", "largest_batch")


def observed(rows: DataFrame, scratch: Scratch, metrics: dict[str, Column]) -> tuple[DataFrame, dict[str, Any]]:
    """``rows`` written, and the values of the metrics over them."""
    seen = Observation()
    written = scratch.save(rows.observe(seen, *(c.alias(k) for k, c in metrics.items())))
    return written, seen.get


def segment_metrics() -> dict[str, Column]:
    """Of rows ``(segment_index, duration, restored, error, engine, engine_reason, batch)``; a row without a segment stands for a recording that has none.

    ``batch(rows, valid, padded, failures, seconds)`` is in one row of each batch, null elsewhere.
    """
    is_segment, batch = F.col("segment_index").isNotNull(), F.col("batch")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return {
        "segments": F.count_if(is_segment),
        "inferred_segments": F.count_if(is_segment & ~F.col("restored") & F.col("error").isNull()),
        "restored_segments": F.count_if(is_segment & F.col("restored")),
        "errors": F.count_if(F.col("error").isNotNull()),
        "segment_seconds": total(F.when(is_segment, F.col("duration")).cast("double")).cast("double"),
        "batches": F.count(batch),
        "batch_rows": total(batch["rows"]),
        "valid_frames": total(batch["valid"]),
        "padded_frames": total(batch["padded"]),
        "memory_failures": total(batch["failures"]),
        "recognition_seconds": total(batch["seconds"]).cast("double"),
        # a batch of no rows tells nothing of sizes
        "least_batch": F.coalesce(F.min(F.nullif(batch["rows"], F.lit(0))), F.lit(0)),
        "largest_batch": F.coalesce(F.max(batch["rows"]), F.lit(0)),
        "engines": F.collect_set("engine"),
        "engine_reasons": F.collect_set("engine_reason"),
    }


def segment_profile(written: DataFrame, seen: dict[str, Any]) -> DataFrame:
    """One row: the metrics of :func:`segment_metrics` and exact quantiles of the lengths of all and of inferred segments, null where there are none.

    The quantiles select from the one written column; nothing else is read again.
    """
    inferred = ~F.col("restored") & F.col("error").isNull()
    kinds = F.explode(F.when(inferred, F.array(*map(F.lit, KINDS))).otherwise(F.array(F.lit(KINDS[0]))))
    spans = written.filter("segment_index is not null").select(kinds.alias("kind"), F.col("duration").cast("double").alias("duration"))
    found = stats.quantiles(spans, "duration", "kind")
    lengths = found.agg(*(F.max(F.when(F.col("kind") == k, F.col(q))).alias(f"{k}_{q}") for k in KINDS for q in ("min", "p50", "p90", "p99", "max")))
    padded = seen["padded_frames"]
    values = [F.lit(int(seen[k])).cast("long").alias(k) for k in WHOLE]
    values += [F.lit(float(seen[k])).alias(k) for k in ("segment_seconds", "recognition_seconds")]
    values += [F.lit(1 - seen["valid_frames"] / padded if padded else 0.0).alias("padding")]
    values += [F.array(*map(F.lit, sorted(seen[k]))).cast("array<string>").alias(k) for k in ("engines", "engine_reasons")]
    return lengths.select(*values, *lengths.columns)


def batch_log(written: DataFrame) -> DataFrame:
    """A row for each batch that succeeded, with its share of padding."""
    return written.filter("batch is not null").select("batch.*").withColumn("padding", F.when(F.col("padded") > 0, 1 - F.col("valid") / F.col("padded")).otherwise(0.0))
