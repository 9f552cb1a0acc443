"""Queries over the driver's tables and their DuckDB SQL.

Each query states its rows as a Spark plan; its SQL is written independently,
with recursive CTEs for the greedy folds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cues as cue_ops
from ..operators import intervals, packing, state, stats, timing, tokens
from ..operators import text as text_ops
from ..sources import discovery
from ..sources.domain import FRAMES, SEGMENTS, SPANS, frames, segments, spans
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LIMITS = cue_ops.CueLimits(chars=80, seconds=6.0, gap=0.6)
DAY_MS = 86_400_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- intervals ---------------------------------------------------------------


@query("""
SELECT doc_id AS job, i AS window_index, i * 480000 AS "begin", least((i + 1) * 480000, n) AS "end" FROM
 (SELECT doc_id, n_chars * 960 AS n, unnest(range((n_chars * 960 + 479999) // 480000)) AS i FROM documents)""")
def fixed_windows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("job"), (F.col("n_chars") * 960).alias("n"))
    return intervals.fixed_windows(d, "n", 480_000).select("job", F.col("window_index").cast("long").alias("window_index"), "begin", "end")


@query("""
SELECT doc_id AS job, i AS window_index, greatest(i * 480000 - 32000, 0) AS "begin", least(i * 480000 + 512000, n) AS "end", greatest(32000 - i * 480000, 0) AS left_pad, greatest(i * 480000 + 512000 - n, 0) AS right_pad
FROM (SELECT doc_id, n_chars * 960 AS n, unnest(range((n_chars * 960 + 479999) // 480000)) AS i FROM documents)""")
def context_windows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("job"), (F.col("n_chars") * 960).alias("n"))
    w = intervals.context_windows(d, "n", 480_000, 32_000)
    return w.select("job", F.col("window_index").cast("long").alias("window_index"), F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), F.col("left_pad").cast("long").alias("left_pad"), F.col("right_pad").cast("long").alias("right_pad"))


@query(f"""
WITH RECURSIVE {SPANS},
o AS (SELECT job, s, e, row_number() OVER (PARTITION BY job ORDER BY s) AS n FROM spans),
m AS (SELECT job, n, s AS a, e AS b, 0 AS g FROM o WHERE n = 1
  UNION ALL SELECT o.job, o.n, CASE WHEN o.e - m.a <= {DAY_MS} THEN m.a ELSE o.s END, o.e, m.g + CASE WHEN o.e - m.a <= {DAY_MS} THEN 0 ELSE 1 END FROM m JOIN o ON o.job = m.job AND o.n = m.n + 1)
SELECT job, g::BIGINT AS merged_index, min(a) AS s, max(b) AS e FROM m GROUP BY job, g""")
def span_merge(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merge_spans(spans(spark, sf), DAY_MS)


@query(f"""
WITH {SPANS}, v AS (SELECT job, span_index, s / 1000.0::DOUBLE - 1704067200 AS s0, e / 1000.0::DOUBLE - 1704067200 AS e0, 2000000.0::DOUBLE AS d FROM spans),
c AS (SELECT *, greatest(0, least(s0, d)) AS cs, greatest(0, least(e0, d)) AS ce, s0 < -0.000125 OR e0 > d + 0.000125 AS outside FROM v),
k AS (SELECT *, lag(ce) OVER (PARTITION BY job ORDER BY s0, e0) AS p FROM c WHERE outside OR ce > cs)
SELECT job, span_index, round(greatest(cs, coalesce(p, 0)), 6) AS s, round(ce, 6) AS e, CASE WHEN outside THEN 'outside the media' WHEN cs < p - 0.000125 THEN 'overlaps the span before' WHEN ce - greatest(cs, coalesce(p, 0)) > 300 + 0.000125 THEN 'too long' END AS fault FROM k""")
def segment_validate(spark: SparkSession, sf: str) -> DataFrame:
    v = spans(spark, sf).select("job", "span_index", (F.col("s") / 1000 - 1704067200).alias("s"), (F.col("e") / 1000 - 1704067200).alias("e"), F.lit(2_000_000.0).alias("d"))
    kept = intervals.validate_spans(v, "job", "s", "e", "d", 300.0)
    return kept.select("job", "span_index", F.round("s", 6).alias("s"), F.round("e", 6).alias("e"), "fault")


@query(f"""
WITH {SPANS}, seg AS (SELECT job, i AS segment_index, lo + i * {DAY_MS} AS a, lo + (i + 1) * {DAY_MS} AS b FROM (SELECT job, min(s) AS lo, unnest(range((max(e) - min(s)) // {DAY_MS} + 1)) AS i FROM spans GROUP BY job))
SELECT spans.job, span_index, segment_index, greatest(s, a) AS s, least(e, b) AS e FROM spans JOIN seg ON spans.job = seg.job AND e > a AND s < b""")
def span_clip(spark: SparkSession, sf: str) -> DataFrame:
    sp = spans(spark, sf)
    whole = sp.groupBy("job").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    seg = whole.select("job", "lo", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(hi - lo) div {DAY_MS}"))).alias("segment_index"))
    seg = seg.select("job", "segment_index", (F.col("lo") + F.col("segment_index") * DAY_MS).alias("start_ms"), (F.col("lo") + (F.col("segment_index") + 1) * DAY_MS).alias("end_ms"))
    return intervals.clip_spans(sp, seg).select("job", "span_index", "segment_index", "s", "e")


@query(f"""
WITH {SPANS}, f AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY job ORDER BY s) > 21600000 THEN 1 ELSE 0 END AS new FROM spans),
g AS (SELECT *, sum(new) OVER (PARTITION BY job ORDER BY s) AS session FROM f)
SELECT job, session::BIGINT AS session, min(s) AS s, max(e) AS e, count(*) AS spans FROM g GROUP BY job, session""")
def gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.gap_sessions(spans(spark, sf), 21_600_000)


@query(f"""
WITH {SPANS}, n AS (SELECT *, s - lag(e) OVER w AS l, lead(s) OVER w - e AS r, max(e) OVER (PARTITION BY job) AS top FROM spans WINDOW w AS (PARTITION BY job ORDER BY s))
SELECT job, span_index, greatest(0, s - CASE WHEN l < 7200000 THEN l // 2 ELSE 3600000 END) AS s, CASE WHEN r < 7200000 THEN e + r // 2 ELSE least(top, e + 3600000) END AS e FROM n""")
def pad_pass(spark: SparkSession, sf: str) -> DataFrame:
    sp = spans(spark, sf).withColumn("top", F.max("e").over(Window.partitionBy("job")))
    return intervals.pad_spans(sp, 3_600_000, F.col("top")).select("job", "span_index", "s", "e")


@query(f"""
WITH RECURSIVE {FRAMES}, z AS (SELECT job, count(*) * 512 AS n FROM frames GROUP BY job),
r AS (SELECT job, -1::BIGINT AS frame, NULL::BIGINT AS st, NULL::BIGINT AS q, NULL::BIGINT AS oa, NULL::BIGINT AS ob FROM z
  UNION ALL SELECT f.job, f.frame,
    CASE WHEN r.st IS NULL THEN CASE WHEN f.prob >= 0.5 THEN f.frame * 512 END WHEN f.prob < 0.35 AND f.frame * 512 - coalesce(r.q, f.frame * 512) >= 1024 THEN NULL ELSE r.st END,
    CASE WHEN r.st IS NULL OR f.prob >= 0.5 THEN NULL WHEN f.prob < 0.35 THEN CASE WHEN f.frame * 512 - coalesce(r.q, f.frame * 512) >= 1024 THEN NULL ELSE coalesce(r.q, f.frame * 512) END ELSE r.q END,
    CASE WHEN r.st IS NOT NULL AND f.prob < 0.35 AND f.frame * 512 - coalesce(r.q, f.frame * 512) >= 1024 AND r.q - r.st > 800 THEN r.st END,
    CASE WHEN r.st IS NOT NULL AND f.prob < 0.35 AND f.frame * 512 - coalesce(r.q, f.frame * 512) >= 1024 AND r.q - r.st > 800 THEN r.q END
  FROM r JOIN frames f ON f.job = r.job AND f.frame = r.frame + 1),
a AS (SELECT job, oa AS s, ob AS e FROM r WHERE oa IS NOT NULL UNION ALL SELECT r.job, r.st, z.n FROM r JOIN z ON z.job = r.job AND r.frame * 512 + 512 = z.n WHERE r.st IS NOT NULL AND z.n - r.st > 800)
SELECT job, row_number() OVER (PARTITION BY job ORDER BY s) - 1 AS span_index, s, e FROM a""")
def vad_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.segment_speech(frames(spark, sf), intervals.Hysteresis(threshold=0.5, low=0.35, min_speech=800, min_silence=1024, pad=0))


@query()
def vad_hysteresis_limited(spark: SparkSession, sf: str) -> DataFrame:
    """With over-long speech cut at its longest silence, and padding; tests hold it against a plain state machine."""
    return intervals.segment_speech(frames(spark, sf), intervals.Hysteresis(max_speech=2 * intervals.SAMPLE_RATE, min_silence=4800, min_speech=8000))


@query(f"""
WITH {FRAMES}, l AS (SELECT job, frame, CASE WHEN prob >= 0.5 THEN 'speech' ELSE 'blank' END AS label FROM frames),
g AS (SELECT *, frame - row_number() OVER (PARTITION BY job, label ORDER BY frame) AS i FROM l)
SELECT job, label, min(frame) AS first, max(frame) AS last FROM g GROUP BY job, label, i""")
def rle_runs(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).select("job", "frame", F.when(F.col("prob") >= 0.5, "speech").otherwise("blank").alias("label"))
    return intervals.run_lengths(f, "job", "frame", "label").select("job", "label", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query(f"""
WITH {SPANS}, t AS (SELECT job, span_index, s - 600000 AS s, e FROM spans)
SELECT job, span_index, greatest(s, coalesce(lag(e) OVER (PARTITION BY job ORDER BY span_index), s)) AS s, e FROM t""")
def word_monotone(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.monotone_starts(spans(spark, sf).withColumn("s", F.col("s") - 600_000), "job", "span_index", "s", "e").select("job", "span_index", "s", "e")


# --- word timing and cues ----------------------------------------------------

SECONDS = f"{SEGMENTS}, seg AS (SELECT job, segment_index, text, start_ms / 1000.0::DOUBLE AS a, end_ms / 1000.0::DOUBLE AS b, string_split_regex(trim(text), '\\s+') AS w FROM segments WHERE trim(text) <> '')"
TIMED = f"""{SECONDS}, words AS (SELECT job, segment_index, i - 1 AS word_index, w[i] AS word, a + (i - 1) * d + sh AS word_start, a + i * d + sh AS word_end FROM
 (SELECT *, greatest(0, b - a) / len(w) AS d, CASE WHEN segment_index % 3 = 2 THEN 0.7::DOUBLE * ((i - 1) // 7) ELSE 0.0 END AS sh FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM seg)))"""


def timed_segments(spark: SparkSession, sf: str) -> DataFrame:
    return segments(spark, sf).select("job", "segment_index", "text", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"))


def timed_words(spark: SparkSession, sf: str) -> DataFrame:
    """Uniform words, with pauses in every third segment so that each cue limit comes to bear."""
    w = timing.uniform_words(timed_segments(spark, sf))
    shift = F.when(F.col("segment_index") % 3 == 2, F.floor(F.col("word_index") / 7) * F.lit(0.7)).otherwise(0.0)
    return w.select("job", "segment_index", F.col("word_index").cast("long").alias("word_index"), "word", (F.col("word_start") + shift).alias("word_start"), (F.col("word_end") + shift).alias("word_end"))


@query(f"WITH {SECONDS} SELECT job, segment_index, (i - 1)::BIGINT AS word_index, w[i] AS word, a + (i - 1) * (greatest(0, b - a) / len(w)) AS word_start, a + i * (greatest(0, b - a) / len(w)) AS word_end FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM seg)")
def word_timings(spark: SparkSession, sf: str) -> DataFrame:
    w = timing.uniform_words(timed_segments(spark, sf))
    return w.select("job", "segment_index", F.col("word_index").cast("long").alias("word_index"), "word", "word_start", "word_end")


HALVES = f"""{SECONDS}, sp AS (SELECT *, len(w) AS n, k AS span_index, CASE k WHEN 0 THEN a WHEN 1 THEN a + (b - a) * 0.5 ELSE a + (b - a) * 0.75 END AS s, CASE k WHEN 0 THEN a + (b - a) * 0.25 WHEN 1 THEN a + (b - a) * 0.625 ELSE b END AS e FROM seg, range(3) t(k)),
x AS (SELECT *, n * (e - s) / sum(e - s) OVER (PARTITION BY job, segment_index) AS exact FROM sp WHERE e > s),
y AS (SELECT *, floor(exact)::BIGINT AS f, n - sum(floor(exact)::BIGINT) OVER (PARTITION BY job, segment_index) AS rest, row_number() OVER (PARTITION BY job, segment_index ORDER BY exact - floor(exact) DESC, e - s DESC, span_index) AS rk FROM x),
dealt AS (SELECT *, f + CASE WHEN rk <= rest THEN 1 ELSE 0 END AS share FROM y)"""


def quarter_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Three speech spans in each segment: its first quarter, an eighth from the middle, and its last quarter."""
    seg, d = timed_segments(spark, sf).filter(F.trim("text") != ""), F.col("end") - F.col("start")
    parts = F.array(*(F.struct(F.lit(k).cast("long").alias("span_index"), (F.col("start") + d * lo if lo else F.col("start")).alias("s"), (F.col("start") + d * hi if hi < 1 else F.col("end")).alias("e")) for k, (lo, hi) in enumerate(((0, 0.25), (0.5, 0.625), (0.75, 1)))))
    return seg.select("job", "segment_index", "text", F.explode(parts).alias("p")).select("job", "segment_index", "text", "p.span_index", F.col("p.s").alias("start"), F.col("p.e").alias("end"))


@query(f"WITH {HALVES} SELECT job, segment_index, span_index, share::BIGINT AS share FROM dealt")
def largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    held = quarter_spans(spark, sf).withColumn("n", F.size(timing.words(F.col("text")))).withColumn("d", F.col("end") - F.col("start"))
    return timing.largest_remainder(held, ["job", "segment_index"], "n", "d", "span_index").select("job", "segment_index", "span_index", "share")


@query(f"""
WITH {HALVES}, p AS (SELECT *, coalesce(sum(share) OVER (PARTITION BY job, segment_index ORDER BY span_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM dealt)
SELECT job, segment_index, before + i AS word_index, w[before + i + 1] AS word, s + i * ((e - s) / share) AS word_start, s + (i + 1) * ((e - s) / share) AS word_end FROM (SELECT *, unnest(range(share)) AS i FROM p WHERE share > 0)""")
def word_timings_spans(spark: SparkSession, sf: str) -> DataFrame:
    w = timing.words_across_spans(quarter_spans(spark, sf), ["job", "segment_index"])
    return w.select("job", "segment_index", F.col("word_index").cast("long").alias("word_index"), "word", "word_start", "word_end")


CUES = f"""{TIMED}, o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY segment_index, word_index) AS n FROM words),
fold AS (SELECT job, n, word_start AS f, word_end AS l, word AS t, 0 AS cue, regexp_matches(word, '[.!?؟،؛…]$') AS ended FROM o WHERE n = 1
 UNION ALL SELECT o.job, o.n, CASE WHEN x THEN o.word_start ELSE fold.f END, o.word_end, CASE WHEN x THEN o.word ELSE fold.t || ' ' || o.word END, fold.cue + CASE WHEN x THEN 1 ELSE 0 END, regexp_matches(o.word, '[.!?؟،؛…]$')
 FROM fold JOIN o ON o.job = fold.job AND o.n = fold.n + 1, LATERAL (SELECT fold.ended OR length(fold.t) + 1 + length(o.word) > 80 OR o.word_end - fold.f > 6.0 OR o.word_start - fold.l > 0.6 AS x)),
cues AS (SELECT job, cue::BIGINT AS cue_index, greatest(0, min(f)) AS "start", greatest(min(f), arg_max(l, n)) AS "end", arg_max(t, n) AS text FROM fold GROUP BY job, cue)"""


def base_cues(spark: SparkSession, sf: str) -> DataFrame:
    return cue_ops.build_cues(timed_words(spark, sf), LIMITS)


@query(f'WITH RECURSIVE {CUES} SELECT job, cue_index, "start", "end", text FROM cues')
def cues(spark: SparkSession, sf: str) -> DataFrame:
    return base_cues(spark, sf).select("job", "cue_index", "start", "end", "text")


EXTENDED = f"""{CUES}, media AS (SELECT job, max("end") * 0.999::DOUBLE AS m FROM cues GROUP BY job),
nx AS (SELECT cues.*, m, lead("start") OVER (PARTITION BY cues.job ORDER BY cue_index) AS nxt FROM cues JOIN media ON media.job = cues.job),
cl AS (SELECT job, cue_index, text, least("start", m) AS s, least("end", m) AS e, least(coalesce(nxt, m), m) AS stop FROM nx),
ext AS (SELECT job, cue_index, s AS "start", CASE WHEN e - s < 0.3 THEN greatest(e, least(s + 0.3, stop)) ELSE e END AS "end", text FROM cl)"""


def extended_cues(spark: SparkSession, sf: str) -> DataFrame:
    c = base_cues(spark, sf)
    media = F.max("end").over(Window.partitionBy("job")) * 0.999
    return cue_ops.extend_cues(c.withColumn("media", media), F.col("media"), LIMITS).drop("media")


@query(f'WITH RECURSIVE {EXTENDED} SELECT job, cue_index, "start", "end", text FROM ext')
def cue_extend(spark: SparkSession, sf: str) -> DataFrame:
    return extended_cues(spark, sf).select("job", "cue_index", "start", "end", "text")


def _stamp(col: str, mark: str, hours: bool) -> str:
    ms = f"round_even(greatest(0, {col}) * 1000, 0)::BIGINT"
    tail = f"printf('%02d:%02d{mark}%03d', {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"
    full = f"printf('%02d:', {ms} // 3600000) || {tail}"
    return full if hours else f"CASE WHEN {ms} >= 3600000 THEN {full} ELSE {tail} END"


@query("WITH RECURSIVE " + EXTENDED + " SELECT job, string_agg((cue_index + 1)::VARCHAR || chr(10) || " + _stamp('"start"', ",", True) + " || ' --> ' || " + _stamp('"end"', ",", True) + " || chr(10) || text || chr(10) || chr(10), '' ORDER BY cue_index) AS srt FROM ext GROUP BY job")
def srt_text(spark: SparkSession, sf: str) -> DataFrame:
    return cue_ops.srt(extended_cues(spark, sf))


@query("WITH RECURSIVE " + EXTENDED + " SELECT job, 'WEBVTT' || chr(10) || chr(10) || string_agg(" + _stamp('"start"', ".", False) + " || ' --> ' || " + _stamp('"end"', ".", False) + " || chr(10) || text || chr(10) || chr(10), '' ORDER BY cue_index) AS vtt FROM ext GROUP BY job")
def vtt_text(spark: SparkSession, sf: str) -> DataFrame:
    return cue_ops.vtt(extended_cues(spark, sf))


@query("SELECT conv_id AS job, coalesce(string_agg(trim(text), chr(10) ORDER BY turn) FILTER (trim(text) <> ''), '') || chr(10) AS txt FROM conversations GROUP BY conv_id")
def plain_text(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "text"))), lambda x: x["text"])
    return segments(spark, sf).groupBy("job").agg(cue_ops.plain_text(lines).alias("txt"))


@query("SELECT event_id, " + _stamp("value * 37", ",", True) + " AS srt, " + _stamp("value * 37", ".", False) + " AS vtt FROM events")
def timestamp_format(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value") * 37
    return table(spark, sf, "events").select("event_id", cue_ops.timestamp(v, ",", True).alias("srt"), cue_ops.timestamp(v, ".", False).alias("vtt"))


@query("SELECT item_id, list_reduce([[]::VARCHAR[]] || list_transform(string_split_regex(trim(text), '\\s+'), lambda w: [w]), lambda a, x: a || ['<star>'] || x) AS starred FROM benchmark WHERE trim(text) <> ''")
def star_interleave(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", timing.star_interleaved(timing.words(F.col("text"))).alias("starred"))


# --- order, groups, batches --------------------------------------------------


def flat_segments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("job"), F.col("turn").alias("segment_index"), (F.length("text") * 0.06).alias("duration"))


@query("SELECT conv_id AS job, turn AS segment_index, row_number() OVER (PARTITION BY conv_id // 16 ORDER BY length(text) * 0.06::DOUBLE DESC, conv_id, turn) AS position FROM conversations")
def duration_sort(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy(F.expr("job div 16")).orderBy(F.desc("duration"), "job", "segment_index")
    return flat_segments(spark, sf).select("job", "segment_index", F.row_number().over(w).cast("long").alias("position"))


@query("""
WITH RECURSIVE d AS (SELECT conv_id AS job, turn AS segment_index, conv_id // 64 AS g, length(text) * 0.06::DOUBLE AS x FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x DESC, job, segment_index) AS n, count(*) OVER (PARTITION BY g) AS c, 24 * greatest(max(x) OVER (PARTITION BY g), 0.25) AS budget FROM d),
h AS (SELECT g, n AS head, 0 AS batch, least(24, greatest(1, floor(budget / x)))::BIGINT AS room FROM o WHERE n = 1
  UNION ALL SELECT o.g, o.n, h.batch + 1, least(24, greatest(1, floor(o.budget / o.x)))::BIGINT FROM h JOIN o ON o.g = h.g AND o.n = h.head + h.room)
SELECT job, segment_index, h.g AS grp, batch::BIGINT AS batch FROM h JOIN o ON o.g = h.g AND o.n >= h.head AND o.n < h.head + h.room""")
def batch_pack(spark: SparkSession, sf: str) -> DataFrame:
    d = flat_segments(spark, sf).withColumn("grp", F.expr("job div 64")).withColumn("minus", -F.col("duration"))
    return packing.fold_rows(d, "grp", ["minus", "job", "segment_index"], "batch", lambda x: packing.take_batches(x, 24), "duration").select("job", "segment_index", "grp", "batch")


@query("""
WITH RECURSIVE d AS (SELECT source, doc_id // 1000 AS shard, doc_id, n_chars * 3840 AS b, row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) AS n FROM documents),
r AS (SELECT source, shard, doc_id, n, 0 AS g, b AS used, 1 AS held FROM d WHERE n = 1
  UNION ALL SELECT d.source, d.shard, d.doc_id, d.n, r.g + CASE WHEN x THEN 1 ELSE 0 END, CASE WHEN x THEN d.b ELSE r.used + d.b END, CASE WHEN x THEN 1 ELSE r.held + 1 END FROM r JOIN d ON d.source = r.source AND d.shard = r.shard AND d.n = r.n + 1, LATERAL (SELECT r.used + d.b > 67108864 OR r.held >= 16 AS x))
SELECT source, shard, doc_id, g::BIGINT AS grp FROM r""")
def group_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Groups within a thousand ids of a source: next-fit is sequential, and a whole source would be one task."""
    d = table(spark, sf, "documents").select("source", F.expr("doc_id div 1000").alias("shard"), "doc_id", (F.col("n_chars") * 3840).alias("bytes"))
    d = d.withColumn("key", F.concat_ws("/", "source", "shard"))
    return packing.fold_rows(d, "key", ["doc_id"], "grp", lambda x: packing.next_fit(x, 67_108_864, 16), "bytes").select("source", "shard", "doc_id", "grp")


@query("""
WITH d AS (SELECT conv_id AS job, list(length(text) * 0.06::DOUBLE ORDER BY length(text) DESC) AS x FROM conversations GROUP BY conv_id),
c AS (SELECT job, i, greatest(i * x[1], (len(x) - i) * x[i + 1]) AS cost FROM (SELECT *, unnest(range(1, len(x))) AS i FROM d))
SELECT job, arg_min(i, cost * 1000000 + i)::BIGINT AS cut FROM c GROUP BY job""")
def oom_split(spark: SparkSession, sf: str) -> DataFrame:
    d = flat_segments(spark, sf).groupBy("job").agg(F.reverse(F.array_sort(F.collect_list("duration"))).alias("x"))
    return d.select("job", packing.oom_split_column(F.col("x")).cast("long").alias("cut")).filter("cut is not null")


@query("""
SELECT doc_id, (ceil(greatest(0, n_chars * 0.06::DOUBLE) * 16000) * 4)::BIGINT AS bytes, CASE WHEN doc_id % 4 = 0 THEN (ceil(greatest(0, n_chars * 0.06::DOUBLE) * 16000) * 4)::BIGINT WHEN doc_id % 4 = 1 THEN ceil(n_chars * 0.06::DOUBLE * 64000)::BIGINT WHEN doc_id % 4 = 2 THEN ceil(n_chars * 0.06::DOUBLE * 64000)::BIGINT + 64000 ELSE 536870912 END AS estimate FROM documents""")
def decoded_bytes(spark: SparkSession, sf: str) -> DataFrame:
    d, case = F.col("n_chars") * 0.06, F.col("doc_id") % 4
    size = packing.decoded_bytes(d).cast("long")
    return table(spark, sf, "documents").select("doc_id", size.alias("bytes"), packing.estimated_bytes(F.when(case == 0, size), F.when(case == 1, d), F.when(case == 2, d), 536_870_912).alias("estimate"))


# --- tokens ------------------------------------------------------------------

ROWS = """ids AS (SELECT doc_id, [(length(w) % 7)::BIGINT FOR w IN string_split_regex(trim(text), '\\s+')] AS g FROM documents)"""


def token_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of all words of a document: a generated row."""
    return table(spark, sf, "documents").select("doc_id", F.transform(timing.words(F.col("text")), lambda w: (F.length(w) % 7).cast("long")).alias("g"))


@query(f"""
WITH {ROWS}, p AS (SELECT doc_id, g, doc_id % 5 = 0 AS looped, list_position(g, 1) AS eos, list_position(g, 0) AS pad FROM ids)
SELECT doc_id, CASE WHEN looped AND pad IS NOT NULL AND (eos IS NULL OR pad < eos) THEN pad - 1 WHEN eos IS NOT NULL THEN eos ELSE len(g) END::BIGINT AS "count", (eos IS NULL AND len(g) >= 40 AND NOT looped) AS truncated FROM p""")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    got = tokens.analyze(F.col("g"), 40, [1], 0, F.col("doc_id") % 5 == 0)
    return token_rows(spark, sf).select("doc_id", got.alias("a")).select("doc_id", F.col("a.count").cast("long").alias("count"), "a.truncated")


@query("""
WITH t AS (SELECT doc_id, [length(w)::BIGINT FOR w IN string_split_regex(trim(text), '\\s+')] AS a FROM documents),
p AS (SELECT doc_id, len(a) AS n, a, unnest(range(8, 33)) AS p FROM t),
q AS (SELECT doc_id, n, p, p <= n // 4 AND n >= 96 AND a[n - p + 1:n] = a[n - 2 * p + 1:n - p] AND a[n - p + 1:n] = a[n - 3 * p + 1:n - 2 * p] AND a[n - p + 1:n] = a[n - 4 * p + 1:n - 3 * p] AS hit FROM p)
SELECT doc_id, max(n)::BIGINT AS n, bool_or(hit) AS looped FROM q GROUP BY doc_id""")
def repetition_guard(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("doc_id", F.transform(timing.words(F.col("text")), lambda w: F.length(w).cast("long")).alias("a"))
    return t.select("doc_id", F.size("a").cast("long").alias("n"), tokens.repeats_at_end(F.col("a")).alias("looped"))


@query("""
WITH t AS (SELECT doc_id, [length(w)::BIGINT FOR w IN string_split_regex(trim(text), '\\s+')] AS a FROM documents),
x AS (SELECT doc_id, unnest(a) AS x, unnest(range(1, len(a) + 1)) AS i FROM t),
e AS (SELECT x.doc_id, p, x.i, coalesce(x.x = y.x, false) AS same FROM x CROSS JOIN range(8, 33) q(p) LEFT JOIN x y ON y.doc_id = x.doc_id AND y.i = x.i - p),
r AS (SELECT doc_id, p, i, i - coalesce(max(CASE WHEN NOT same THEN i END) OVER (PARTITION BY doc_id, p ORDER BY i), 0) AS run FROM e),
h AS (SELECT doc_id, min(i) FILTER (run >= 3 * p AND i >= 96) AS point FROM r GROUP BY doc_id)
SELECT t.doc_id, point::BIGINT AS point, CASE WHEN list_position(a, 12) IS NULL OR list_position(a, 12) > point THEN point END::BIGINT AS stopped FROM t LEFT JOIN h USING (doc_id)""")
def loop_points(spark: SparkSession, sf: str) -> DataFrame:
    """Where the tokens of each document first loop, and where a decoder stops for it: not after an end token, here 12."""
    t = table(spark, sf, "documents").select("doc_id", F.transform(timing.words(F.col("text")), lambda w: F.length(w).cast("long")).alias("a"))
    return t.select("doc_id", *(tokens.repetition_point(F.col("a"), eos).alias(n) for n, eos in (("point", []), ("stopped", [12]))))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN c - p < 128 THEN c ELSE p END AS next_limit FROM (SELECT *, least(c, greatest(cur + 128, 2 * cur)) AS p FROM (SELECT l_orderkey, l_linenumber, least(l_partkey, 1024 - l_suppkey % 64) AS c, (l_quantity * 16)::BIGINT AS cur FROM lineitem))")
def retry_limit(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", tokens.retry_limit(F.lit(1024), F.col("l_suppkey") % 64, (F.col("l_quantity") * 16).cast("long"), F.col("l_partkey")).cast("long").alias("next_limit"))


@query("""
WITH p AS (SELECT conv_id AS job, CASE WHEN conv_id % 7 = 3 AND turn = 1 THEN 0 WHEN conv_id % 7 = 4 AND turn = 1 THEN 40 ELSE turn END AS i, trim(text) AS t, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
g AS (SELECT job, count(*) AS c, count(DISTINCT i) AS k, min(i) AS lo, max(i) AS hi, max(n) AS n, list(t ORDER BY i) AS texts FROM p GROUP BY job)
SELECT job, CASE WHEN lo < 0 OR hi >= n THEN 'index outside' WHEN c > k THEN 'repeated' WHEN k < n THEN 'missing' END AS fault, CASE WHEN lo >= 0 AND hi < n AND c = k AND k = n THEN texts END AS texts FROM g""")
def chunk_reassembly(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    odd = F.col("conv_id") % 7
    i = F.when((odd == 3) & (F.col("turn") == 1), 0).when((odd == 4) & (F.col("turn") == 1), 40).otherwise(F.col("turn"))
    parts = c.select(F.col("conv_id").alias("job"), i.alias("i"), "text", F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    return tokens.reassemble(parts, "job", "i", "text", "n").select("job", "fault", "texts")


MESSAGES = """m AS (SELECT event_id, ['MemoryError', 'RuntimeError', 'TypeError', 'ValueError'][event_id % 4 + 1] AS kind,
 CASE event_id % 6 WHEN 0 THEN 'CUDA out of memory: tried ' || event_id || ' MiB' WHEN 1 THEN 'CUDA error: an illegal memory access at 0x' || printf('%x', event_id * 977) WHEN 2 THEN '  bad   value ' || value || chr(10) || 'in row ' || user_id WHEN 3 THEN '' WHEN 4 THEN repeat('long ', 120) || event_id ELSE event_type END AS msg FROM events)"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    e, k = table(spark, sf, "events"), F.col("event_id") % 6
    msg = (
        F.when(k == 0, F.concat(F.lit("CUDA out of memory: tried "), F.col("event_id"), F.lit(" MiB")))
        .when(k == 1, F.concat(F.lit("CUDA error: an illegal memory access at 0x"), F.lower(F.hex(F.col("event_id") * 977))))
        .when(k == 2, F.concat(F.lit("  bad   value "), F.col("value"), F.lit("\nin row "), F.col("user_id")))
        .when(k == 3, "")
        .when(k == 4, F.concat(F.repeat(F.lit("long "), F.lit(120)), F.col("event_id")))
        .otherwise(F.col("event_type"))
    )
    return e.select("event_id", F.element_at(F.array(*map(F.lit, ("MemoryError", "RuntimeError", "TypeError", "ValueError"))), (F.col("event_id") % 4 + 1).cast("int")).alias("kind"), msg.alias("msg"))


@query(f"""
WITH {MESSAGES}, x AS (SELECT event_id, kind, lower(msg) AS t FROM m)
SELECT event_id, CASE
  WHEN kind IN ('MemoryError', 'OutOfMemoryError') OR regexp_matches(t, 'out of memory|cannot allocate memory|cublas_status_alloc_failed|cuda error: memory allocation|cuda_error_memory_allocation|cudaerrormemoryallocation|cudnn_status_alloc_failed|defaultcpuallocator') THEN 'oom'
  WHEN kind IN ('AssertionError', 'AttributeError', 'ImportError', 'IndexError', 'KeyError', 'NotImplementedError', 'TypeError') THEN 'fatal'
  WHEN regexp_matches(t, 'cublas_status|cuda error|cudnn_status|device-side assert|driver shutting down|hip error|illegal memory access|mps backend failed|unspecified launch failure') THEN 'fatal'
  ELSE 'error' END AS class FROM x""")
def failure_class(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("event_id", tokens.failure_class(F.col("kind"), F.col("msg")).alias("class"))


@query(f"""
WITH {MESSAGES}, f AS (SELECT event_id, kind, trim(regexp_replace(msg, '\\s+', ' ', 'g')) AS t FROM m)
SELECT event_id, kind || ': ' || regexp_replace(regexp_replace(left(CASE WHEN t = '' THEN '<no message>' ELSE t END, 500), '0x[0-9a-fA-F]+', '0x*', 'g'), '\\b[0-9]+\\b', '#', 'g') AS fingerprint FROM f""")
def failure_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("event_id", tokens.failure_fingerprint(F.col("kind"), F.col("msg")).alias("fingerprint"))


# --- statistics --------------------------------------------------------------


def results(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", (F.col("n_chars") * 0.06).alias("duration"), "text")
    error = F.when(F.col("doc_id") % 11 == 5, "ValueError: bad audio")
    return d.select("*", (F.col("doc_id") % 7 == 2).alias("skipped"), error.alias("error")).withColumn("status", stats.status(F.col("skipped"), F.col("error")))


RESULTS = "res AS (SELECT doc_id, source, lang, text, n_chars * 0.06::DOUBLE AS duration, CASE WHEN doc_id % 7 = 2 THEN 'skipped' WHEN doc_id % 11 = 5 THEN 'failed' ELSE 'completed' END AS status FROM documents)"


@query(f"""WITH {RESULTS} SELECT count(*) AS results, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, round(coalesce(sum(duration) FILTER (status = 'completed'), 0), 6) AS audio_seconds, round(coalesce(sum(duration) FILTER (status = 'completed'), 0) / 60, 6) AS real_time_factor, count(*) FILTER (status = 'failed') = 0 AS ok FROM res""")
def run_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return stats.run_statistics(results(spark, sf), 60.0)


@query(f"WITH {RESULTS} SELECT doc_id, status, CASE WHEN status = 'failed' THEN NULL ELSE text END AS text FROM res")
def status_partition(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).select("doc_id", "status", F.when(F.col("status") != "failed", F.col("text")).alias("text"))


@query(f"""WITH {RESULTS}, c AS (SELECT * FROM res WHERE status = 'completed') SELECT source, min(duration) AS min, round(quantile_cont(duration, 0.5), 9) AS p50, round(quantile_cont(duration, 0.9), 9) AS p90, round(quantile_cont(duration, 0.99), 9) AS p99, max(duration) AS max FROM c GROUP BY source""")
def duration_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return stats.quantiles(results(spark, sf).filter("status = 'completed'"), "duration", "source")


@query(f"""WITH {SEGMENTS} SELECT job, count(*) AS segments, sum(end_ms - start_ms)::BIGINT AS speech_ms, sum(length(text))::BIGINT AS chars, list(segment_index ORDER BY segment_index) FILTER (length(text) > 400) AS long_segments FROM segments GROUP BY job""")
def file_rollup(spark: SparkSession, sf: str) -> DataFrame:
    s = segments(spark, sf).groupBy("job").agg(F.count("*").alias("segments"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), F.sum(F.length("text")).alias("chars"), F.array_sort(F.collect_list(F.when(F.length("text") > 400, F.col("segment_index")))).alias("long_segments"))
    return s.withColumn("long_segments", F.when(F.size("long_segments") > 0, F.col("long_segments")))


@query(f"WITH {RESULTS} SELECT source, list_sort(list(DISTINCT lang) FILTER (status <> 'failed')) AS engines FROM res GROUP BY source")
def distinct_engines(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).groupBy("source").agg(F.array_sort(F.collect_set(F.when(F.col("status") != "failed", F.col("lang")))).alias("engines"))


@query("""WITH i AS (SELECT conv_id // 24 AS b, ceil(length(text) * 6 / 10.0)::BIGINT AS f FROM conversations), p AS (SELECT b, sum(f) AS valid, count(*) * max(f) AS padded FROM i GROUP BY b)
SELECT count(*) AS batches, sum(valid)::BIGINT AS valid, sum(padded)::BIGINT AS padded, round(1 - sum(valid) / sum(padded), 9) AS padding FROM p""")
def padding_ratio(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "conversations").select(F.expr("conv_id div 24").alias("b"), F.ceil(F.length("text") * 6 / 10.0).cast("long").alias("f"))
    return stats.padding_ratio(i, ["b"], "f")


@query("SELECT event_id, round(60.0::DOUBLE * value / sum(value) OVER (PARTITION BY user_id), 6) AS share FROM events")
def inference_share(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("seconds", F.lit(60.0))
    return stats.share_of_batch(e, "user_id", "value", "seconds").select("event_id", F.round("share", 6).alias("share"))


@query("""
WITH p AS (SELECT vec_id, [exp(x::DOUBLE) FOR x IN embedding] AS e, embedding FROM embeddings)
SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS label, round(list_max(embedding)::DOUBLE - ln(list_sum(e)), 5) AS log_prob FROM p""")
def log_softmax(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    top = F.array_max(v)
    # with the greatest taken out, no exponential overflows
    norm = top + F.ln(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return table(spark, sf, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("label"), F.round(top - norm, 5).alias("log_prob"))


# --- discovery, state --------------------------------------------------------


@query("SELECT page_id, coalesce(regexp_extract(lower(split_part(split_part(url, '?', 1), '#', 1)), '[^/](\\.[^./]+)$', 1), '') AS suffix, coalesce(regexp_extract(lower(split_part(split_part(url, '?', 1), '#', 1)), '[^/](\\.[^./]+)$', 1), '') IN ('.html', '.wav') AS wanted FROM pages")
def suffix_filter(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf, "pages").select("page_id", discovery.suffix(path).alias("suffix"), discovery.suffix(path).isin(".html", ".wav").alias("wanted"))


@query("SELECT page_id, path FROM (SELECT page_id, lower(regexp_replace(regexp_replace(url, '^[a-z]+://(www\\.|m\\.|blog\\.)?', ''), '[?#].*$', '')) AS path FROM pages) QUALIFY row_number() OVER (PARTITION BY path ORDER BY page_id) = 1")
def input_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.lower(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://(www\.|m\.|blog\.)?", ""), "[?#].*$", "")).alias("path"))
    return discovery.first_of(p, "path", ["page_id"]).select("page_id", "path")


@query("""
WITH j AS (SELECT doc_id, source || '/' || doc_id % 300 || '.txt' AS output, source || '/' || doc_id % 450 || CASE WHEN doc_id % 9 = 0 THEN '.txt' ELSE '.wav' END AS input FROM documents),
c AS (SELECT output, count(*) AS claims FROM j GROUP BY output)
SELECT output, claims, CASE WHEN claims > 1 THEN 'claimed twice' ELSE 'is an input' END AS fault FROM c WHERE claims > 1 OR output IN (SELECT input FROM j)""")
def output_collisions(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda n, ext: F.concat(F.col("source"), F.lit("/"), (F.col("doc_id") % n).cast("string"), ext)
    j = table(spark, sf, "documents").select(discovery.output_path(F.col("source"), F.concat((F.col("doc_id") % 300).cast("string"), F.lit(".mp3")), "txt").alias("output"), name(450, F.when(F.col("doc_id") % 9 == 0, ".txt").otherwise(".wav")).alias("input"))
    return discovery.collisions(j, "output", "input")


@query("SELECT doc_id, sha256(text) AS sha256, 1 + (('0x' || left(sha256(text), 16))::UBIGINT::HUGEINT % 9223372036854775806)::BIGINT AS lock_offset FROM documents")
def content_sha256(spark: SparkSession, sf: str) -> DataFrame:
    """The hash of each text and the lock's place that follows from it; nulls for a null text."""
    digest = F.sha2("text", 256)
    offset = (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(9223372036854775806).cast("decimal(20,0)") + 1).cast("long")
    return table(spark, sf, "documents").select("doc_id", digest.alias("sha256"), offset.alias("lock_offset"))


PUBLISHED = "pub AS (SELECT doc_id, sha256(text) AS digest, CASE WHEN quality = 1 THEN 'k1' ELSE 'k2' END AS contract FROM documents JOIN labels USING (doc_id))"


def published(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Jobs, and the published marks of some of them."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.lit("k1").alias("contract"))
    marks = d.join(table(spark, sf, "labels"), "doc_id").select("doc_id", "digest", F.when(F.col("quality") == 1, "k1").otherwise("k2").alias("contract"))
    return d, marks


@query(f"WITH {PUBLISHED} SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM pub WHERE pub.doc_id = d.doc_id AND pub.digest = sha256(d.text) AND contract = 'k1')")
def skip_verified(spark: SparkSession, sf: str) -> DataFrame:
    jobs, marks = published(spark, sf)
    return state.to_run(jobs, marks, ["doc_id", "digest", "contract"]).select("doc_id")


@query("SELECT d.doc_id, l.quality IS NOT NULL AND l.quality = 1 AS loaded, CASE WHEN l.quality = 1 THEN l.toxic END AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def resume_left_join(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "documents").select("doc_id")
    return state.resumed(jobs, table(spark, sf, "labels"), "doc_id", F.col("quality") == 1).select("doc_id", "loaded", "toxic")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 AND quality = 1 THEN 'skip' ELSE 'build' END AS on_skip, CASE WHEN doc_id % 4 > 0 THEN 'abort' ELSE 'build' END AS on_error, 'build' AS on_overwrite FROM labels")
def existing_policy(spark: SparkSession, sf: str) -> DataFrame:
    n, complete = F.col("doc_id") % 4, F.col("quality") == 1
    return table(spark, sf, "labels").select("doc_id", *(state.existing_policy(p, F.lit(3), n, complete).alias(f"on_{p}") for p in ("skip", "error", "overwrite")))


@query(f"""WITH {SEGMENTS} SELECT job, json_extract_string(j, '$.job')::BIGINT AS id, len(json_extract(j, '$.segments[*]'))::BIGINT AS n, json_extract_string(j, '$.segments[0].text') AS head
FROM (SELECT job, json_object('job', job, 'segments', list({{'i': segment_index, 'text': text}} ORDER BY segment_index) FILTER (trim(text) <> '')) AS j FROM segments GROUP BY job)""")
def json_document(spark: SparkSession, sf: str) -> DataFrame:
    kept = segments(spark, sf).filter(F.trim("text") != "")
    doc = kept.groupBy("job").agg(F.array_sort(F.collect_list(F.struct(F.col("segment_index").alias("i"), "text"))).alias("segments"))
    j = doc.select("job", text_ops.document(F.struct("job", "segments")).alias("j"))
    return j.select("job", F.get_json_object("j", "$.job").cast("long").alias("id"), F.json_array_length(F.get_json_object("j", "$.segments")).cast("long").alias("n"), F.get_json_object("j", "$.segments[0].text").alias("head"))


@query()
def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """All items; DuckDB has no NFKC, so tests hold this against a plain statement of the steps."""
    return table(spark, sf, "benchmark").select("item_id", text_ops.normalized(F.col("text")).alias("norm"))


@query()
def wer_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Word errors of each turn against the one before it; tests hold the counts against a plain table."""
    c = table(spark, sf, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = c.select("conv_id", "turn", before.alias("reference"), F.col("text").alias("hypothesis")).filter("reference is not null")
    return stats.word_errors(pairs, "reference", "hypothesis").select("conv_id", "turn", "units", "substitutions", "deletions", "insertions")
