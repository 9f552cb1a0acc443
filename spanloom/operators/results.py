"""Rules about jobs and their results: joins, checks, roll-ups and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .stats import interpolated, selected
from .text import casefold

SAMPLE_RATE, FRAME_MS = 16_000, 32


def zipped(times: Column, texts: Column) -> Column:
    """``(pairs, fault)`` of two arrays that have to be of one length."""
    same = F.size(times) == F.size(texts)
    pairs = F.zip_with(times, texts, lambda a, b: F.struct(a.alias("time"), b.alias("text")))
    return F.struct(F.when(same, pairs).alias("pairs"), F.when(~same, "lengths differ").alias("fault"))


def generation_metadata(refs: DataFrame, rows: DataFrame, ref: str) -> DataFrame:
    """``refs`` with the most tokens of their generated rows, and whether any was stopped or limited; null and false without rows."""
    known = rows.groupBy(ref).agg(F.max("tokens").alias("tokens"), F.max("stopped").alias("stopped"), F.max("limited").alias("limited"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return refs.join(known, ref, "left").select(*refs.columns, "tokens", flag("stopped"), flag("limited"))


def vad_rollup(groups: DataFrame, sums: list[str], files: str, block: str) -> DataFrame:
    """One row: sums over prepared groups, the most files of a call, and the least block that isn't zero."""
    return groups.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums), F.coalesce(F.max(files), F.lit(0)).alias(files), F.coalesce(F.min(F.nullif(F.col(block), F.lit(0))), F.lit(0)).alias(block))


def prepared_rollup(batches: DataFrame, discarded: Column, *values: str) -> DataFrame:
    """One row: the sums of prepared batches that were used, and apart from them of those that were discarded."""
    used = [F.coalesce(F.sum(F.when(~discarded, F.col(c))), F.lit(0)).alias(c) for c in values]
    lost = [F.coalesce(F.sum(F.when(discarded, F.col(c))), F.lit(0)).alias(f"discarded_{c}") for c in values]
    return batches.agg(F.count_if(~discarded).alias("batches"), F.count_if(discarded).alias("discarded"), *used, *lost)


def inferred_durations(segments: DataFrame, duration: str, generated: Column, restored: Column) -> DataFrame:
    """Two rows: count, sum and quartiles of all segments' durations, and of those recognised in this run."""
    rows = segments.select(F.col(duration).alias("d"), F.explode(F.when(generated & ~restored, F.array(F.lit("all"), F.lit("inferred"))).otherwise(F.array(F.lit("all")))).alias("kind"))
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    found = selected(rows, "d", ["kind"], list(quartiles.values()), Scratch(segments.sparkSession, "quantiles")).select("kind", *(F.round(interpolated(p), 9).alias(n) for n, p in quartiles.items()))
    return rows.groupBy("kind").agg(F.count("*").alias("segments"), F.round(F.sum("d"), 6).alias("seconds")).join(found, "kind", "left")


def packed_stats(items: DataFrame, pack: str, frames: str) -> DataFrame:
    """One row: files, calls, frames, and frames with each pack's padding to its longest."""
    per = items.groupBy(pack).agg(F.count("*").alias("files"), F.sum(frames).alias("valid"), F.max(frames).alias("longest"))
    return per.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.count("*").alias("calls"), F.coalesce(F.sum("valid"), F.lit(0)).alias("valid"), F.coalesce(F.sum(F.col("files") * F.col("longest")), F.lit(0)).alias("padded"))


def warning_counts(results: DataFrame, failed: Column, **sets: Column) -> DataFrame:
    """One row: over jobs that didn't fail, the sizes of each kind's set of segments, added up."""
    return results.filter(~failed).agg(*(F.coalesce(F.sum(F.greatest(F.size(c), F.lit(0))), F.lit(0)).alias(n) for n, c in sets.items()))


def in_order(results: DataFrame, index: str = "job_index") -> DataFrame:
    """Results in the order of their inputs."""
    return results.orderBy(index)


def sliced(results: DataFrame, start: int, stop: int, index: str = "job_index") -> DataFrame:
    """The results from place ``start`` to before ``stop`` in the order of their inputs: a limit, so that no whole table is numbered in one task."""
    first = results.orderBy(index).limit(max(0, stop))
    return first.orderBy(index).offset(start) if start > 0 else first


def shown_first(labels: Column, most: int = 10) -> Column:
    """``(shown, more)``: the first labels, and how many there are besides."""
    return F.struct(F.slice(labels, 1, most).alias("shown"), F.greatest(F.size(labels) - most, F.lit(0)).alias("more"))


def lock_order(locks: DataFrame, path: str, offset: str, identity: str, group: str) -> DataFrame:
    """``locks`` with ``turn``: the order to take a group's locks in, by case-folded path, offset and case-folded identity."""
    w = Window.partitionBy(group).orderBy(casefold(path), offset, casefold(identity))
    return locks.withColumn("turn", F.row_number().over(w))


def verified_outputs(wanted: DataFrame, held: DataFrame, job: str) -> DataFrame:
    """``(job, verified)``: whether a job's published files are exactly those wanted, with their names, sizes and hashes.

    Both have a row ``(job, format, name, size, sha256)`` for each file.
    """
    cols = ["name", "size", "sha256"]
    a, b = wanted.select(job, "format", F.struct(*cols).alias("a")), held.select(job, "format", F.struct(*cols).alias("b"))
    same = a.join(b, [job, "format"], "full").select(job, F.col("a").eqNullSafe(F.col("b")).alias("same"))
    return same.groupBy(job).agg(F.bool_and("same").alias("verified"))


def source_unchanged(before: Column, after: Column) -> Column:
    """The fault of a source whose snapshot is another one now; null if it is the same."""
    return F.when(~before.eqNullSafe(after), "source changed while it was processed")


def limit_fault(seconds: Column, bytes_: Column, cap: int) -> Column:
    """The fault of a recording that would decode, or has decoded, to more bytes than the cap."""
    expected = F.ceil(F.greatest(F.lit(0.0), seconds) * SAMPLE_RATE) * 4
    return F.when(expected > cap, "duration over the limit").when(bytes_ > cap, "samples over the limit")


def decode_choice(requested: Column, fast: Column, slow: Column, fast_error: Column, over_limit: Column) -> Column:
    """``(backend, fallback_reason, error)`` of a decode: ``auto`` takes the fast decoder if it is there, and the slow one after a failure that is no limit."""
    auto = requested == "auto"
    first = F.when(auto, F.when(fast, "torchcodec").when(slow, "ffmpeg")).otherwise(requested)
    failed = (first == "torchcodec") & fast_error.isNotNull()
    again = failed & auto & slow & ~over_limit
    error = F.when(first.isNull(), "no decoder is there").when(failed & ~again, fast_error)
    return F.struct(F.when(error.isNull(), F.when(again, "ffmpeg").otherwise(first)).alias("backend"), F.when(again, fast_error).alias("fallback_reason"), error.alias("error"))


def checked_spans(spans: DataFrame, job: str, index: str, start: str, end: str, duration: str) -> DataFrame:
    """``(job, fault, spans)``: a stored list of spans, all or nothing; its end may pass the duration by a millionth, and is moved back."""
    s, e, d = F.col(start), F.col(end), F.col(duration)
    finite = (F.abs(s) < float("inf")) & (F.abs(e) < float("inf")) & ~F.isnan(s) & ~F.isnan(e)
    inside = F.coalesce(finite & (s >= 0) & (s <= e) & (e <= d + 1e-6), F.lit(False))
    early = s < F.lag(end).over(Window.partitionBy(job).orderBy(index))
    fault = F.when(~inside, "out of range").when(early, "overlapping or out of order")
    rows = spans.select(job, F.col(index).alias("i"), fault.alias("f"), s.alias("s"), F.least(d, e).alias("e"))
    got = rows.groupBy(job).agg(F.min_by("f", F.when(F.col("f").isNotNull(), F.col("i"))).alias("fault"), F.array_sort(F.collect_list(F.struct("i", "s", "e"))).alias("spans"))
    return got.select(job, "fault", F.when(F.col("fault").isNull(), F.transform("spans", lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end")))).alias("spans"))


def restore_fault(times: Column, texts: Column, sets: list[Column], token_rows: Column) -> Column:
    """The first fault of a checkpoint's payload; nothing of it is used if there is one."""
    n = F.size(times)
    bad_set = lambda x: (F.size(F.array_distinct(x)) != F.size(x)) | F.exists(x, lambda i: (i < 0) | (i >= n))
    fault = F.when(n != F.size(texts), "texts and times differ in number")
    for k, x in enumerate(sets):
        fault = fault.when(bad_set(x), f"index set {k} is not valid")
    return fault.when(bad_set(F.transform(token_rows, lambda r: r["index"])) | F.exists(token_rows, lambda r: r["tokens"] < 0), "token rows are not valid")


def window_fault(most_seconds: Column, clip_seconds: Column) -> Column:
    """The fault of segments that may be longer than what a processor takes as one row."""
    return F.when(most_seconds > clip_seconds + 1e-9, "segments can be longer than one row of the processor")


def effective_frames(most: Column, block_seconds: Column) -> Column:
    """Frames that a batch may hold, by their number and by their time."""
    return F.least(most, F.floor(block_seconds * 1000 / FRAME_MS + 1e-9))


def segmentation_parameters(mode: Column, parameters: dict[str, tuple[str, ...]], values: dict[str, Column]) -> Column:
    """The map of the parameters that a mode of segmenting uses."""
    out = None
    for name, used in parameters.items():
        made = F.create_map(*(x for u in used for x in (F.lit(u), values[u].cast("string"))))
        out = F.when(mode == name, made) if out is None else out.when(mode == name, made)
    return out


def version_at_least(version: Column, major: int, minor: int) -> Column:
    """Whether a version's first two numbers are not below the given ones; false for what isn't a version."""
    number = lambda k: F.regexp_extract(version, r"^(\d+)\.(\d+)", k).try_cast("int")
    return F.coalesce((number(1) > major) | (number(1) == major) & (number(2) >= minor), F.lit(False))


def default_batch(device: Column) -> Column:
    """Rows of a batch unless told otherwise."""
    return F.when(device == "cuda", 24).when(device == "mps", 8).otherwise(4)


def corpus_errors(counts: DataFrame, *keys: str) -> DataFrame:
    """Summed edit counts over summed units: the corpus rate, not the mean of the rows' rates."""
    names = ("units", "substitutions", "deletions", "insertions")
    got = counts.groupBy(*keys).agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    return got.withColumn("rate", F.when(F.col("units") > 0, F.round((F.col("substitutions") + F.col("deletions") + F.col("insertions")) / F.col("units"), 9)))


def character_errors(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """``pairs`` with ``units`` and ``distance``: characters of the reference, and edits to the hypothesis."""
    ref, hyp = (F.coalesce(F.col(c), F.lit("")) for c in (reference, hypothesis))
    return pairs.withColumn("units", F.length(ref).cast("long")).withColumn("distance", F.levenshtein(ref, hyp).cast("long"))
