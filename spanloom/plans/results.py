"""Queries of the rules about jobs and their results, with their SQL; registered with those of :mod:`driver`."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import align, models, packing, profile, state, stats, timing
from ..operators import results as ops
from ..operators.folds import fold_groups
from ..operators.intervals import validate_spans
from ..sources import probe
from ..sources.domain import SEGMENTS, SPANS, segments, spans
from ..sources.scratch import Scratch
from ..sources.tables import table
from .driver import query


@query("""
WITH c AS (SELECT conv_id AS job, list(turn ORDER BY turn) AS times, list(text ORDER BY turn) FILTER (conv_id % 7 <> 3 OR turn > 0) AS texts FROM conversations GROUP BY conv_id)
SELECT job, CASE WHEN len(times) = coalesce(len(texts), 0) THEN len(times) END::BIGINT AS pairs, CASE WHEN len(times) = len(texts) THEN texts[len(texts)] END AS last_text, CASE WHEN len(times) <> coalesce(len(texts), 0) THEN 'lengths differ' END AS fault FROM c""")
def timed_texts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("job"))
    held = F.when((F.col("conv_id") % 7 != 3) | (F.col("turn") > 0), F.struct("turn", "text"))
    c = c.agg(F.array_sort(F.collect_list("turn")).alias("times"), F.transform(F.array_sort(F.collect_list(held)), lambda x: x["text"]).alias("texts"))
    z = c.select("job", ops.zipped(F.col("times"), F.col("texts")).alias("z"))
    return z.select("job", F.when(F.col("z.fault").isNull(), F.size("z.pairs")).cast("long").alias("pairs"), F.try_element_at("z.pairs", F.lit(-1))["text"].alias("last_text"), "z.fault")


@query("""
WITH r AS (SELECT l_orderkey % 1000 AS ref, max(l_quantity)::BIGINT AS tokens, bool_or(l_linenumber = 7) AS stopped, bool_or(l_quantity >= 50) AS limited FROM lineitem GROUP BY 1)
SELECT c_custkey * 11 AS ref, tokens, coalesce(stopped, false) AS stopped, coalesce(limited, false) AS limited FROM customer LEFT JOIN r ON r.ref = c_custkey * 11""")
def ref_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """All rows' tokens by their reference; references of 1000 and more have none."""
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 1000).alias("ref"), F.col("l_quantity").cast("long").alias("tokens"), (F.col("l_linenumber") == 7).alias("stopped"), (F.col("l_quantity") >= 50).alias("limited"))
    return ops.generation_metadata(table(spark, sf, "customer").select((F.col("c_custkey") * 11).alias("ref")), rows, "ref")


@query("SELECT coalesce(sum(o_orderkey % 11), 0)::BIGINT AS calls, coalesce(sum(o_custkey % 13), 0)::BIGINT AS valid, coalesce(max(o_orderkey % 17), 0)::BIGINT AS files, coalesce(min(nullif(o_custkey % 5 * 100, 0)), 0)::BIGINT AS block FROM orders")
def vad_rollup(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "orders").select((F.col("o_orderkey") % 11).cast("long").alias("calls"), (F.col("o_custkey") % 13).cast("long").alias("valid"), (F.col("o_orderkey") % 17).cast("long").alias("files"), (F.col("o_custkey") % 5 * 100).cast("long").alias("block"))
    return ops.vad_rollup(g, ["calls", "valid"], "files", "block")


BATCHES = "b AS (SELECT l_suppkey AS grp, l_orderkey AS batch, count(*) AS rows, sum(l_quantity)::BIGINT AS frames, (count(*) * max(l_quantity))::BIGINT AS padded, max(l_partkey)::BIGINT AS tokens, l_orderkey % 13 = 0 AS failed FROM lineitem GROUP BY 1, 2)"


def batch_rows(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    b = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("grp"), F.col("l_orderkey").alias("batch"))
    return b.agg(F.count("*").alias("rows"), F.sum(q).cast("long").alias("frames"), (F.count("*") * F.max(q)).cast("long").alias("padded"), F.max("l_partkey").cast("long").alias("tokens")).withColumn("failed", F.col("batch") % 13 == 0)


@query(f"""WITH {BATCHES} SELECT grp, count(*) FILTER (NOT failed) AS batches, count(*) FILTER (failed) AS memory_failures, coalesce(sum(rows) FILTER (NOT failed), 0)::BIGINT AS rows, coalesce(sum(frames) FILTER (NOT failed), 0)::BIGINT AS frames, coalesce(sum(padded) FILTER (NOT failed), 0)::BIGINT AS padded,
coalesce(sum(tokens) FILTER (NOT failed), 0)::BIGINT AS tokens, max(rows) FILTER (NOT failed) AS largest, min(rows) FILTER (NOT failed) AS least FROM b GROUP BY grp""")
def batch_history(spark: SparkSession, sf: str) -> DataFrame:
    return stats.batch_rollup(batch_rows(spark, sf), "grp")


@query(f"""WITH {BATCHES} SELECT count(*) FILTER (NOT failed) AS batches, count(*) FILTER (failed) AS discarded, coalesce(sum(rows) FILTER (NOT failed), 0)::BIGINT AS rows, coalesce(sum(frames) FILTER (NOT failed), 0)::BIGINT AS frames, coalesce(sum(rows) FILTER (failed), 0)::BIGINT AS discarded_rows, coalesce(sum(frames) FILTER (failed), 0)::BIGINT AS discarded_frames FROM b""")
def prepared_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ops.prepared_rollup(batch_rows(spark, sf), F.col("failed"), "rows", "frames")


@query(f"""WITH {SEGMENTS}, k AS (SELECT (end_ms - start_ms) / 1000.0::DOUBLE AS d, unnest(CASE WHEN segment_index % 2 = 0 AND job % 5 <> 0 THEN ['all', 'inferred'] ELSE ['all'] END) AS kind FROM segments)
SELECT kind, count(*) AS segments, round(sum(d), 6) AS seconds, round(quantile_cont(d, 0.25), 9) AS p25, round(quantile_cont(d, 0.5), 9) AS p50, round(quantile_cont(d, 0.75), 9) AS p75 FROM k GROUP BY kind""")
def inferred_durations(spark: SparkSession, sf: str) -> DataFrame:
    s = segments(spark, sf).select("job", "segment_index", ((F.col("end_ms") - F.col("start_ms")) / 1000).alias("duration"))
    return ops.inferred_durations(s, "duration", F.col("segment_index") % 2 == 0, F.col("job") % 5 == 0)


@query("SELECT sum(n)::BIGINT AS files, count(*) AS calls, sum(v)::BIGINT AS valid, sum(n * m)::BIGINT AS padded FROM (SELECT conv_id // 16 AS p, count(*) AS n, sum(length(text)) AS v, max(length(text)) AS m FROM conversations GROUP BY 1)")
def packed_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.expr("conv_id div 16").alias("pack"), F.length("text").cast("long").alias("frames"))
    return ops.packed_stats(c, "pack", "frames")


@query("""WITH w AS (SELECT conv_id, count(*) FILTER (turn % 3 = 1) AS a, count(*) FILTER (length(text) > 400) AS b FROM conversations WHERE conv_id % 11 <> 5 GROUP BY 1)
SELECT coalesce(sum(a), 0)::BIGINT AS limited, coalesce(sum(b), 0)::BIGINT AS stopped FROM w""")
def warning_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set(F.when(F.col("turn") % 3 == 1, F.col("turn"))).alias("a"), F.collect_set(F.when(F.length("text") > 400, F.col("turn"))).alias("b"))
    got = ops.warning_counts(c, F.col("conv_id") % 11 == 5, limited=F.col("a"), stopped=F.col("b"))
    return got.select(*(F.col(n).cast("long").alias(n) for n in got.columns))


@query(f"""WITH {SEGMENTS}, x AS (SELECT job, segment_index, (end_ms - start_ms) / 1000.0::DOUBLE AS d, ceil(length(text) * 6 / 10.0)::BIGINT AS f, job // 24 AS b, job % 5 = 0 AS restored, CASE WHEN job % 7 = 3 AND segment_index = 1 THEN 'broken' END AS error FROM segments),
calls AS (SELECT b, count(*) AS n, sum(f) AS valid, count(*) * max(f) AS padded, b % 3 AS failures FROM x WHERE NOT restored GROUP BY b),
q AS (SELECT d FROM x WHERE NOT restored AND error IS NULL)
SELECT (SELECT count(*) FROM x) AS segments, (SELECT count(*) FROM q) AS inferred_segments, (SELECT count(*) FROM x WHERE restored) AS restored_segments, (SELECT count(*) FROM x WHERE error IS NOT NULL) AS errors, c.*, a.*, i.*,
 (SELECT list_sort(list(DISTINCT 'engine' || job % 3)) FROM x WHERE NOT restored) AS engines, (SELECT list_sort(list(DISTINCT 'engine' || (job % 3 - 1) || ' is not here')) FROM x WHERE NOT restored AND job % 3 > 0) AS engine_reasons
FROM (SELECT count(*) AS batches, sum(n)::BIGINT AS batch_rows, sum(valid)::BIGINT AS valid_frames, sum(padded)::BIGINT AS padded_frames, sum(failures)::BIGINT AS memory_failures, min(n) AS least_batch, max(n) AS largest_batch, round(1 - sum(valid) / sum(padded), 9) AS padding FROM calls) AS c,
(SELECT round(sum(d), 6) AS segment_seconds, min(d) AS all_min, round(quantile_cont(d, 0.5), 9) AS all_p50, round(quantile_cont(d, 0.9), 9) AS all_p90, round(quantile_cont(d, 0.99), 9) AS all_p99, max(d) AS all_max FROM x) AS a,
(SELECT min(d) AS inferred_min, round(quantile_cont(d, 0.5), 9) AS inferred_p50, round(quantile_cont(d, 0.9), 9) AS inferred_p90, round(quantile_cont(d, 0.99), 9) AS inferred_p99, max(d) AS inferred_max FROM q) AS i""")
def run_profile(spark: SparkSession, sf: str) -> DataFrame:
    """A run's profile, observed while its segments are written: turns as segments, a batch for each 24 conversations' turns that no checkpoint has."""
    job, frames = F.col("job"), F.ceil(F.length("text") * 6 / 10.0).cast("long")
    s = segments(spark, sf).select("job", "segment_index", ((F.col("end_ms") - F.col("start_ms")) / 1000).alias("duration"), frames.alias("frames"), F.expr("job div 24").alias("b"), (job % 5 == 0).alias("restored"), F.when((job % 7 == 3) & (F.col("segment_index") == 1), "broken").alias("error"))
    whole = Window.partitionBy("b", "restored")
    n, valid, padded = F.count("*").over(whole), F.sum("frames").over(whole), F.count("*").over(whole) * F.max("frames").over(whole)
    call = F.struct(n.alias("rows"), valid.alias("valid"), padded.alias("padded"), (F.col("b") % 3).alias("failures"), (valid / 50).alias("seconds"))
    first = F.row_number().over(whole.orderBy("job", "segment_index")) == 1
    new = ~F.col("restored")
    rows = s.withColumn("batch", F.when(new & first, call)).withColumn("engine", F.when(new, F.concat(F.lit("engine"), job % 3))).withColumn("engine_reason", F.when(new & (job % 3 > 0), F.concat(F.lit("engine"), job % 3 - 1, F.lit(" is not here"))))
    written, seen = profile.observed(rows, Scratch(spark, "profile"), profile.segment_metrics())
    got = profile.segment_profile(written, seen).drop("recognition_seconds")
    return got.withColumns({"padding": F.round("padding", 9), "segment_seconds": F.round("segment_seconds", 6)})


@query("SELECT doc_id AS job_index, source FROM documents ORDER BY doc_id LIMIT 25 OFFSET 15")
def result_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Results 15 to 40 in the order of their inputs: the slice is the feature."""
    return ops.sliced(table(spark, sf, "documents").select(F.col("doc_id").alias("job_index"), "source"), 15, 40)


@query("SELECT source, list(DISTINCT lang ORDER BY lang)[1:2] AS shown, greatest(count(DISTINCT lang) - 2, 0)::BIGINT AS more FROM documents GROUP BY source")
def shown_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    return d.select("source", ops.shown_first(F.col("langs"), 2).alias("s")).select("source", "s.shown", F.col("s.more").cast("long").alias("more"))


@query("SELECT page_id, row_number() OVER (PARTITION BY page_id // 50 ORDER BY lower(url), page_id % 3, lower(reverse(url)), page_id) AS turn FROM pages")
def lock_order(spark: SparkSession, sf: str) -> DataFrame:
    """Pages in the order of their locks; in ASCII, which these URLs are, lower case is the folded one that the SQL lacks."""
    p = table(spark, sf, "pages").select("page_id", "url", F.expr("page_id div 50").alias("grp"), (F.col("page_id") % 3).alias("off"), F.concat(F.reverse("url"), F.lpad(F.col("page_id").cast("string"), 12, "0")).alias("identity"))
    return ops.lock_order(p, "url", "off", "identity", "grp").select("page_id", F.col("turn").cast("long").alias("turn"))


@query("""
WITH f AS (SELECT doc_id, unnest(['srt', 'txt']) AS format, sha256(text) AS h, length(text) AS n FROM documents)
SELECT doc_id, NOT (doc_id % 6 = 1 OR doc_id % 6 = 2 OR doc_id % 6 = 3 OR doc_id % 6 = 4) AS verified FROM f GROUP BY doc_id""")
def verified_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests of which one in six lacks a file, has one too many, another size or another hash; the files of a null text are empty."""
    d, odd = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit(""))), F.col("doc_id") % 6
    files = d.select("doc_id", "text", F.explode(F.array(F.lit("srt"), F.lit("txt"))).alias("format")).select("doc_id", "format", F.concat(F.col("doc_id").cast("string"), F.lit("."), "format").alias("name"), F.length("text").alias("size"), F.sha2("text", 256).alias("sha256"))
    held = files.filter((odd != 1) | (F.col("format") == "txt"))
    held = held.unionByName(files.filter((odd == 2) & (F.col("format") == "txt")).withColumn("format", F.lit("vtt")))
    held = held.withColumn("size", F.when(odd == 3, F.col("size") + 1).otherwise(F.col("size"))).withColumn("sha256", F.when(odd == 4, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return ops.verified_outputs(files, held, "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 2 OR doc_id % 9 = 4 THEN 'source changed while it was processed' END AS fault FROM documents")
def source_check(spark: SparkSession, sf: str) -> DataFrame:
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    snap = lambda size, time: F.struct(F.lit(1).alias("device"), i.alias("inode"), size.alias("size"), time.alias("mtime"))
    before = snap(F.col("n_chars"), F.when(i % 9 != 8, i))
    after = snap(F.when(i % 5 == 2, F.col("n_chars") + 1).otherwise(F.col("n_chars")), F.when(i % 9 == 4, i + 1).when(i % 9 != 8, i))
    return d.select("doc_id", ops.source_unchanged(before, after).alias("fault"))


@query("""
SELECT doc_id, CASE WHEN ceil(n_chars * 0.06::DOUBLE * 16000) * 4 > 2000000 THEN 'duration over the limit' WHEN n_chars * 4000 > 2000000 THEN 'samples over the limit' END AS fault FROM documents""")
def decode_limits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", ops.limit_fault(F.col("n_chars") * 0.06, F.col("n_chars") * 4000, 2_000_000).alias("fault"))


@query("""
WITH d AS (SELECT event_id, ['auto', 'ffmpeg', 'torchcodec'][event_id % 3 + 1] AS req, event_id % 4 <> 0 AS fast, event_id % 5 <> 0 AS slow, CASE WHEN event_id % 7 = 1 THEN 'bad header' END AS err, event_id % 14 = 1 AS lim FROM events),
f AS (SELECT *, CASE WHEN req <> 'auto' THEN req WHEN fast THEN 'torchcodec' WHEN slow THEN 'ffmpeg' END AS first FROM d),
g AS (SELECT *, coalesce(first = 'torchcodec' AND err IS NOT NULL, false) AS failed FROM f), h AS (SELECT *, failed AND req = 'auto' AND slow AND NOT lim AS again FROM g)
SELECT event_id, CASE WHEN again THEN 'ffmpeg' WHEN NOT failed THEN first END AS backend, CASE WHEN again THEN err END AS fallback_reason, CASE WHEN first IS NULL THEN 'no decoder is there' WHEN failed AND NOT again THEN err END AS error FROM h""")
def decode_fallback(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    requested = F.element_at(F.array(*map(F.lit, ("auto", "ffmpeg", "torchcodec"))), (i % 3 + 1).cast("int"))
    c = ops.decode_choice(requested, i % 4 != 0, i % 5 != 0, F.when(i % 7 == 1, "bad header"), i % 14 == 1)
    return table(spark, sf, "events").select("event_id", c.alias("c")).select("event_id", "c.backend", "c.fallback_reason", "c.error")


@query(f"""
WITH {SPANS}, v AS (SELECT job, span_index, (s - 1704067200000) / 16000.0::DOUBLE AS a, (e - 1704067200000) / 16000.0::DOUBLE AS b FROM spans),
c AS (SELECT job, span_index, greatest(0, least(a, 120000)) AS a, greatest(0, least(b, 120000)) AS b FROM v)
SELECT job, span_index, round(a, 7) AS s, round(b, 7) AS e FROM c WHERE b > a""")
def sample_seconds(spark: SparkSession, sf: str) -> DataFrame:
    """Sample positions as seconds within the media, and then validated."""
    sp = spans(spark, sf).select("job", "span_index", *(F.greatest(F.lit(0.0), F.least(F.lit(120_000.0), (F.col(c) - 1704067200000) / 16000)).alias(c) for c in ("s", "e")))
    kept = validate_spans(sp.filter("e > s").withColumn("d", F.lit(120_000.0)), "job", "s", "e", "d", 1e9)
    return kept.filter("fault is null").select("job", "span_index", F.round("s", 7).alias("s"), F.round("e", 7).alias("e"))


@query(f"""
WITH {SPANS}, v AS (SELECT job, span_index AS i, s - CASE WHEN job % 7 = 2 AND span_index % 5 = 1 THEN 90000000 ELSE 0 END AS s, e, CASE WHEN job % 11 = 3 THEN 1705000000000 ELSE 1999999999999 END AS d FROM spans),
f AS (SELECT *, NOT (0 <= s AND s <= e AND e <= d + 0.000001) AS out, s < lag(e) OVER (PARTITION BY job ORDER BY i) AS early FROM v)
SELECT job, arg_min(CASE WHEN out THEN 'out of range' ELSE 'overlapping or out of order' END, i) FILTER (out OR early) AS fault, CASE WHEN NOT bool_or(out OR coalesce(early, false)) THEN count(*) END AS spans FROM f GROUP BY job""")
def checkpoint_spans(spark: SparkSession, sf: str) -> DataFrame:
    back = F.when((F.col("job") % 7 == 2) & (F.col("span_index") % 5 == 1), 90_000_000).otherwise(0)
    sp = spans(spark, sf).select("job", "span_index", (F.col("s") - back).cast("double").alias("s"), F.col("e").cast("double").alias("e"), F.when(F.col("job") % 11 == 3, 1705000000000.0).otherwise(1999999999999.0).alias("d"))
    return ops.checked_spans(sp, "job", "span_index", "s", "e", "d").select("job", "fault", F.when(F.col("spans").isNotNull(), F.size("spans")).cast("long").alias("spans"))


@query("""
WITH c AS (SELECT conv_id AS job, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT job, CASE WHEN job % 8 = 1 THEN 'texts and times differ in number' WHEN job % 8 = 2 OR job % 8 = 3 AND n > 0 THEN 'index set 0 is not valid' WHEN job % 8 = 4 THEN 'index set 1 is not valid' WHEN job % 8 = 5 OR job % 8 = 6 THEN 'token rows are not valid' END AS fault FROM c""")
def checkpoint_restore(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("job")).agg(F.collect_list("turn").alias("times"))
    n, case = F.size("times"), F.col("job") % 8
    ints = lambda *x: F.array(*(F.lit(v) if isinstance(v, int) else v for v in x))
    limited = F.when(case == 2, ints(n)).when(case == 3, ints(0, 0)).otherwise(ints(0))
    stopped = F.when(case == 4, ints(-1)).otherwise(F.array().cast("array<int>"))
    row = lambda i, t: F.struct(F.lit(i).alias("index"), F.lit(t).alias("tokens"))
    rows = F.when(case == 5, F.array(row(0, 4), row(0, 5))).when(case == 6, F.array(row(0, -4))).otherwise(F.array(row(0, 4)))
    texts = F.when(case == 1, F.array_append("times", F.lit(0))).otherwise(F.col("times"))
    return c.select("job", ops.restore_fault(F.col("times"), texts, [limited, stopped], rows).alias("fault"))


@query("SELECT p_partkey, CASE WHEN p_size > 30 + 0.000000001 THEN 'segments can be longer than one row of the processor' END AS fault, least(p_size * 40, floor(p_retailprice / 1000 * 1000 / 32 + 0.000000001))::BIGINT AS frames FROM part")
def batch_limits(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", ops.window_fault(F.col("p_size"), F.lit(30)).alias("fault"), ops.effective_frames((F.col("p_size") * 40).cast("double"), F.col("p_retailprice") / 1000).cast("long").alias("frames"))


PARAMETERS = {"silero": ("threshold", "pad"), "auditok": ("energy", "silence"), "none": ("window",)}


@query("""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pad=60,threshold=0.5' WHEN 1 THEN 'energy=50.0,silence=' || doc_id % 4 ELSE 'window=30' END AS parameters FROM documents""")
def segmentation_parameters(spark: SparkSession, sf: str) -> DataFrame:
    mode = F.element_at(F.array(*map(F.lit, PARAMETERS)), (F.col("doc_id") % 3 + 1).cast("int"))
    values = {"threshold": F.lit("0.5"), "pad": F.lit(60), "energy": F.lit("50.0"), "silence": F.col("doc_id") % 4, "window": F.lit(30)}
    entries = F.array_sort(F.map_entries(ops.segmentation_parameters(mode, PARAMETERS, values)))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("parameters"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN false ELSE p_size // 10 > 2 OR p_size // 10 = 2 AND p_size % 10 >= 4 END AS new_enough, CASE p_partkey % 3 WHEN 0 THEN 24 WHEN 1 THEN 8 ELSE 4 END AS batch FROM part""")
def host_choices(spark: SparkSession, sf: str) -> DataFrame:
    version = F.when(F.col("p_partkey") % 9 == 0, "unknown").otherwise(F.concat(F.expr("p_size div 10"), F.lit("."), F.col("p_size") % 10, F.lit(".1+cu")))
    device = F.element_at(F.array(*map(F.lit, ("cuda", "mps", "cpu"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", ops.version_at_least(version, 2, 4).alias("new_enough"), ops.default_batch(device).alias("batch"))


@query()
def corpus_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Word errors of turns against the ones before, over all of a conversation; held against plain tables."""
    c = table(spark, sf, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = c.select("conv_id", before.alias("reference"), F.col("text").alias("hypothesis")).filter("reference is not null")
    return ops.corpus_errors(stats.word_errors(pairs, "reference", "hypothesis"), "conv_id")


def _mix_sql(x: str) -> str:
    """The 32-bit hash of :func:`stats.mixed` as SQL over a column ``x`` of a subquery chain."""
    for multiplier, shift in zip(stats.MIXERS, (16, 15), strict=True):
        x = f"(xor({x}, {x} >> {shift}) * {multiplier} % 4294967296)"
    return f"xor({x}, {x} >> 15)"


@query(f"""
WITH t AS (SELECT CASE WHEN conv_id % 5 = 0 THEN 'u' || conv_id || '/' || turn ELSE 's' || conv_id END AS cluster, string_split_regex(trim(text), '\\s+') AS w FROM conversations),
c AS (SELECT cluster, sum(len(w))::BIGINT AS u, sum(len(list_filter(w, lambda x: length(x) > 7)))::BIGINT AS a, sum(len(list_filter(w, lambda x: length(x) % 4 = 1)))::BIGINT AS b FROM t GROUP BY cluster),
k AS (SELECT *, ('0x' || md5(cluster)[1:8])::BIGINT AS w0, ('0x' || md5(cluster)[9:16])::BIGINT AS w1 FROM c),
x AS (SELECT u, a, b, w1, r, (w0 + r * 2654435769) % 4294967296 AS x FROM k, range(5000) AS q(r)), y AS (SELECT u, a, b, r, xor({_mix_sql("x")}, w1) AS x FROM x), z AS (SELECT u, a, b, r, {_mix_sql("x")} AS x FROM y),
m AS (SELECT *, {" + ".join(f"(x >= {bound})::INT" for bound in stats.POISSON)} AS m FROM z),
d AS (SELECT r, (sum(m * a) - sum(m * b))::DOUBLE / sum(m * u) AS d FROM m GROUP BY r HAVING sum(m * u) > 0),
q AS (SELECT quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM d)
SELECT count(*) AS clusters, sum(u)::BIGINT AS units, round(sum(a)::DOUBLE / sum(u), 9) AS rate, round(sum(b)::DOUBLE / sum(u), 9) AS other_rate, round((sum(a) - sum(b))::DOUBLE / sum(u), 9) AS difference, round(any_value(low), 9) AS low, round(any_value(high), 9) AS high FROM c, q""")
def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Two systems' errors on the words of all turns, with 5,000 replicates over speakers, or turns where no speaker is known."""
    words = timing.words(F.col("text"))
    cluster = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("u"), "conv_id", F.lit("/"), "turn")).otherwise(F.concat(F.lit("s"), "conv_id"))
    long, odd = (F.size(F.filter(words, f)) for f in (lambda w: F.length(w) > 7, lambda w: F.length(w) % 4 == 1))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.size(words).alias("units"), long.alias("errors"), odd.alias("others"))
    return stats.bootstrap_interval(turns, cluster, "units", "errors", "others")


@query()
def character_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of whole items and their edits to the items backwards; DuckDB's distance counts bytes, so a plain table holds this."""
    r = F.lower("text")
    return ops.character_errors(table(spark, sf, "benchmark").select("item_id", r.alias("r"), F.reverse(r).alias("h")), "r", "h").select("item_id", "units", "distance")


@query("""
WITH RECURSIVE d AS (SELECT event_id, event_id * 37 % 1200 AS need FROM events),
r AS (SELECT event_id, need, 100::BIGINT AS lim, false AS retried FROM d
  UNION ALL SELECT event_id, need, CASE WHEN 896 - least(896, greatest(lim + 128, 2 * lim)) < 128 THEN 896 ELSE least(896, greatest(lim + 128, 2 * lim)) END, true FROM r WHERE need > lim AND lim < 896)
SELECT event_id, least(need, max(lim))::BIGINT AS tokens, bool_or(retried) AS retried, need > max(lim) AS limited FROM r GROUP BY event_id, need""")
def truncation_retries(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that need more tokens than the limit run again with larger ones, up to 896."""

    def run(batches):
        generate = lambda items, limit: [("", min(n, limit), n > limit) for n in items]
        for pdf in batches:
            got = models.with_retries(generate, pdf["need"].tolist(), 100, 896)
            yield pdf[["event_id"]].assign(tokens=[g["tokens"] for g in got], retried=[g["retried"] for g in got], limited=[g["limited"] for g in got])

    e = table(spark, sf, "events").select("event_id", (F.col("event_id") * 37 % 1200).alias("need"))
    return e.mapInPandas(run, "event_id long, tokens long, retried boolean, limited boolean")


@query("""
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value FROM events),
r AS (SELECT user_id, 0::BIGINT AS n, 16::BIGINT AS cur, 64::BIGINT AS most, 0::BIGINT AS cool FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT r.user_id, e.n,
    CASE WHEN e.value >= 40 THEN CASE WHEN cur <= 1 THEN 1 ELSE greatest(1, least(least(most, cur - 1), cur // 2)) END WHEN cool > 0 THEN cur ELSE greatest(1, least(greatest(cur + CASE WHEN e.value < 30 THEN 1 ELSE 0 END, floor(cur * CASE WHEN e.value < 10 THEN 1.25::DOUBLE WHEN e.value < 30 THEN 1.125::DOUBLE ELSE 1 END)::BIGINT), most)) END,
    CASE WHEN e.value >= 40 AND cur > 1 THEN least(most, cur - 1) ELSE most END,
    CASE WHEN e.value >= 40 THEN CASE WHEN cur > 1 THEN greatest(cool, 2) ELSE cool END WHEN cool > 0 THEN cool - 1 ELSE 0 END
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, n - 1 AS step, cur AS size FROM r WHERE n > 0""")
def batch_learning(spark: SparkSession, sf: str) -> DataFrame:
    """The batch size that each user's events leave: a failure from a value of 40 on, else a success with some headroom."""

    def fold(values: list[float]) -> list[tuple]:
        size, out = packing.BatchSize(16), []
        for k, v in enumerate(values):
            size.failed(size.current) if v >= 40 else size.succeeded(0.5 if v < 10 else 0.1 if v < 30 else 0.0)
            out.append((k, size.current))
        return out

    return fold_groups(table(spark, sf, "events").select("user_id", "event_id", "ts", "value"), "user_id", ["ts", "event_id"], ["value"], fold, [("step", T.LongType()), ("size", T.LongType())])


@query()
def vad_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds of blocks that packs of sixteen conversations go through; held against what a pack has to keep to."""

    def fold(turns: list[int], frames: list[int]) -> list[tuple]:
        rounds = packing.pack_blocks(frames, 40, 8, 200, 260)
        return [(turns[k], n, r) for r, taken in enumerate(rounds) for k, n in taken]

    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.ceil(F.length("text") / 32.0)).cast("long").alias("frames")).withColumn("pack", F.expr("conv_id div 16"))
    return fold_groups(c, "pack", ["conv_id"], ["conv_id", "frames"], fold, [("conv_id", T.LongType()), ("frames", T.LongType()), ("round", T.LongType())])


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN o_custkey + 0.5 WHEN o_orderkey % 5 = 2 AND o_custkey > 1 THEN o_custkey - 1.0 ELSE o_custkey::DOUBLE END::DOUBLE AS hint FROM orders WHERE o_orderkey % 3 <> 0""")
def probe_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Durations from probes of the recordings that no checkpoint has: stream, container less its start, or neither."""
    o, i, c = table(spark, sf, "orders"), F.col("o_orderkey") % 5, F.col("o_custkey")
    dur = lambda x: F.struct(x.cast("string").alias("duration"))
    whole = lambda d, s: F.struct(d.cast("string").alias("duration"), s.cast("string").alias("start_time"))
    none = F.lit("N/A")
    streams = F.when(i == 1, F.array(dur(none), dur(c + 0.5))).when(i > 2, F.array(dur(c))).otherwise(F.array(dur(none)))
    form = F.when(i == 2, whole(c, F.lit(1.0))).when(i == 0, whole(F.lit("-1"), none)).otherwise(whole(c + 7, F.lit(0.0)))
    probes = o.select("o_orderkey", F.to_json(F.struct(streams.alias("streams"), form.alias("format"))).alias("probe"))
    todo = probes.join(o.filter("o_orderkey % 3 = 0").select("o_orderkey"), "o_orderkey", "left_anti")
    return todo.select("o_orderkey", probe.probed_duration(F.col("probe")).alias("hint"))


@query("""
SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'state integrity check failed' WHEN 2 THEN 'state schema is unsupported' WHEN 3 THEN 'state is unreadable' END AS fault, CASE WHEN doc_id % 5 IN (0, 4) THEN '{"doc":' || doc_id || '}' END AS payload FROM documents""")
def envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Stored envelopes opened: some with another payload, another version or cut short."""
    i = F.col("doc_id")
    body = F.concat(F.lit('{"doc":'), i.cast("string"), F.lit("}"))
    kept = F.when(i % 5 == 1, F.concat(F.lit('{"doc":-'), i.cast("string"), F.lit("1}"))).otherwise(body)
    text = F.concat(F.lit('{"payload":'), kept, F.lit(',"payload_sha256":"'), F.sha2(body, 256), F.lit('","schema_version":'), F.when(i % 5 == 2, "9").otherwise("1"), F.lit("}"))
    text = F.when(i % 5 == 3, F.substring(text, 1, 40)).otherwise(text)
    return state.opened_envelopes(table(spark, sf, "documents").select("doc_id", text.alias("state")), "state")


@query()
def word_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Words of turns aligned with scores that spell them; held against where the scores put the words."""
    letters = "abcdefghijklmnopqrstuvwxyz'"
    ids = {c: k + 1 for k, c in enumerate(letters)}
    codes = np.array([ids.get(chr(k), 0) for k in range(128)])

    def scores(text: str, start: float, end: float) -> np.ndarray:
        """Two frames for each letter and a blank between words, as an emission model would see clear speech."""
        spelt = codes[np.frombuffer("".join(f"{w} " for w in align.plain_tokens(text)).encode(), np.uint8)]
        path = np.stack([spelt, spelt, np.zeros_like(spelt)], axis=1)[np.stack([spelt > 0, spelt > 0, spelt >= 0], axis=1)]
        out = np.full((max(1, len(path)), len(letters) + 2), -9.0)
        out[np.arange(len(path)), path] = 0.0
        out[:, -1] = 0.0
        return out

    s = segments(spark, sf).select("job", "segment_index", "text", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"))
    return align.aligned_words(s, scores, ids, 20.0)
