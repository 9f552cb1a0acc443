"""Generated tokens: counts, truncation, repetition, retry limits and reassembly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the repetition guard.
LEAST_TOKENS, REPEATS, LEAST_PERIOD, MOST_PERIOD = 96, 4, 8, 32

#: Parts of messages that tell a memory failure, and a failure of the device.
OOM_MARKERS = ("out of memory", "cannot allocate memory", "cublas_status_alloc_failed", "cuda error: memory allocation", "cuda_error_memory_allocation", "cudaerrormemoryallocation", "cudnn_status_alloc_failed", "defaultcpuallocator")
FATAL_MARKERS = ("cublas_status", "cuda error", "cudnn_status", "device-side assert", "driver shutting down", "hip error", "illegal memory access", "mps backend failed", "unspecified launch failure")
#: Exception types that tell a memory failure.
OOM_TYPES = ("MemoryError", "OutOfMemoryError")
#: Exception types that tell a fault of the program.
FATAL_TYPES = ("AssertionError", "AttributeError", "ImportError", "IndexError", "KeyError", "NotImplementedError", "TypeError")


def repeats_at_end(tokens: Column) -> Column:
    """Whether the last four blocks of some period from 8 to 32 are equal, in an array of at least 96 tokens."""
    n = F.size(tokens)
    top = F.least(F.lit(MOST_PERIOD), F.floor(n / REPEATS).cast("int"))
    at = lambda i: F.get(tokens, n - 1 - i)
    periods = F.sequence(F.lit(LEAST_PERIOD), F.greatest(top, F.lit(LEAST_PERIOD)))
    loops = F.exists(periods, lambda p: F.forall(F.sequence(p, REPEATS * p - 1), lambda i: at(i) == at(i - p)))
    return F.when(n >= LEAST_TOKENS, loops).otherwise(F.lit(False))


def first_loop(tokens: np.ndarray) -> int | None:
    """The length of the shortest prefix that ends in four equal blocks of some period, in time linear in the tokens.

    A prefix ends so if its last three blocks' tokens all equal those a period
    before them: for each period, the runs of such tokens are measured once.
    """
    n, best = len(tokens), None
    for p in range(LEAST_PERIOD, min(MOST_PERIOD, n // REPEATS) + 1):
        same = tokens[p:] == tokens[:-p]
        place = np.arange(len(same))
        run = place - np.maximum.accumulate(np.where(same, -1, place))
        long = np.flatnonzero(run >= (REPEATS - 1) * p)
        # the shortest prefix that is looked at may lie inside a run
        k = np.searchsorted(long, LEAST_TOKENS - p - 1)
        if k < len(long) and (best is None or long[k] + p + 1 < best):
            best = int(long[k]) + p + 1
    return best


def repetition_point(tokens: Column, eos: list[int]) -> Column:
    """The length of the first prefix that loops, before any end token; null if there is none."""

    @F.pandas_udf("long")
    def point(rows: pd.Series) -> pd.Series:
        out: list[int | None] = []
        for row in rows:
            found = None if row is None else first_loop(np.asarray(row))
            out.append(None if found is None or eos and np.isin(row[:found], eos).any() else found)
        return pd.Series(out, dtype="Int64")

    return point(tokens)


def analyze(generated: Column, limit: int, eos: list[int], pad: int | None, looped: Column) -> Column:
    """(count, truncated) of a generated row: up to and with the first end token, or before the padding of a looped row."""
    n = F.size(generated)
    stops = F.transform(generated, lambda t, i: F.when(t.isin(eos), i + 1).when(looped & (t == pad) if pad is not None else F.lit(False), i))
    first = F.get(F.filter(stops, lambda s: s.isNotNull()), F.lit(0))
    saw = F.exists(generated, lambda t: t.isin(eos))
    return F.struct(F.coalesce(first, n).alias("count"), (~saw & (n >= limit) & ~looped).alias("truncated"))


def retry_limit(positions: Column, prompt: Column, current: Column, requested: Column) -> Column:
    """The next token limit of a truncated row: 128 more or twice as many, or the ceiling if that leaves less than 128."""
    ceiling = F.least(requested, positions - prompt)
    proposed = F.least(ceiling, F.greatest(current + 128, current * 2))
    return F.when(ceiling - proposed < 128, ceiling).otherwise(proposed)


def reassemble(parts: DataFrame, job: str, index: str, text: str, expected: str) -> DataFrame:
    """``(job, texts, fault)``: texts by index; a missing, repeated or outside index makes the job's texts null."""
    n = F.max(expected)
    groups = parts.groupBy(job).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.trim(F.col(text)).alias("t")))).alias("p"), F.count("*").alias("rows"), F.count_distinct(index).alias("kinds"), F.min(index).alias("low"), F.max(index).alias("high"), n.alias("n"))
    fault = F.when((F.col("low") < 0) | (F.col("high") >= F.col("n")), "index outside").when(F.col("rows") > F.col("kinds"), "repeated").when(F.col("kinds") < F.col("n"), "missing")
    return groups.select(job, F.when(fault.isNull(), F.transform("p", lambda x: x["t"])).alias("texts"), fault.alias("fault"))


def failure_class(kind: Column, message: Column) -> Column:
    """oom, fatal or error; memory failures are told first."""
    has = lambda marks: F.lower(message).rlike("|".join(marks))
    return F.when(kind.isin(*OOM_TYPES) | has(OOM_MARKERS), "oom").when(kind.isin(*FATAL_TYPES) | has(FATAL_MARKERS), "fatal").otherwise("error")


def failure_fingerprint(kind: Column, message: Column) -> Column:
    """Type and message with white space collapsed, cut at 500 characters, then numbers masked."""
    flat = F.trim(F.regexp_replace(F.coalesce(message, F.lit("")), r"(?U)\s+", " "))
    short = F.substring(F.when(flat == "", "<no message>").otherwise(flat), 1, 500)
    return F.concat(kind, F.lit(": "), F.regexp_replace(F.regexp_replace(short, "0x[0-9a-fA-F]+", "0x*"), r"\b\d+\b", "#"))
