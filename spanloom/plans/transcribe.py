"""A whole run: recordings to segments, texts, words, cues and results.

The plan is lazy but for the table of recognised segments, which is written to
the scratch folder so that no recogniser runs twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.worker import once
from ..operators import align, intervals, models, profile, state, stats, timing
from ..operators import cues as cue_ops
from ..operators import text as text_ops
from ..options import OptionError, Options
from ..sources.publish import manifest, publish
from ..sources.scratch import Scratch

SpeechModel = Callable[[np.ndarray], np.ndarray]
ALIGNED = "array<struct<word:string,word_start:double,word_end:double,timing_source:string>>"
SEGMENT = "job_index long, segment_index long, start double, end double, speech array<struct<start:double,end:double>>, clip binary, error string, engine string, engine_reason string"


def loudness(pcm: np.ndarray) -> np.ndarray:
    """A stand-in for a speech model: each frame's share of a loud frame's energy."""
    size = intervals.WINDOW_SAMPLES
    padded = np.zeros(-(-len(pcm) // size) * size)
    padded[: len(pcm)] = pcm
    return np.clip(np.sqrt((padded.reshape(-1, size) ** 2).mean(1)) / 3000, 0, 1)


def recording_segments(pcm: np.ndarray, options: Options, model: SpeechModel) -> tuple[list[tuple[float, float]], list[tuple[float, float]]]:
    """(segments, speech spans) in seconds of one recording's 16-bit samples, checked."""
    rate = intervals.SAMPLE_RATE
    check = lambda spans: intervals.checked(spans, len(pcm) / rate, options.max_dur)
    if options.vad == "none":
        step = max(1, int(np.rint(options.max_dur * rate)))
        spans = check([(a / rate, min(a + step, len(pcm)) / rate) for a in range(0, len(pcm), step)])
        return spans, spans
    if options.vad == "auditok":
        spans = intervals.energy_spans(pcm, rate, options.energy_threshold, options.min_dur, options.max_dur, options.max_silence)
        return check(spans), spans
    speech = check([(a / rate, b / rate) for a, b in intervals.speech_spans(model(pcm), len(pcm), options.hysteresis())])
    if not options.vad_merge or not speech:
        return speech, speech
    a = np.array(speech)
    return check(intervals.merge_sorted(a[:, 0], a[:, 1], options.max_dur, 1e-9)), speech


def segmented(recordings: DataFrame, options: Options, model: SpeechModel = loudness, most_seconds: float | None = None, engines: dict[str, Callable[[], SpeechModel]] | None = None) -> DataFrame:
    """A row for each segment with its clip; a recording that can't be read, or lasts too long, has one row with its error.

    ``engines`` make speech models in place of ``model``, by name: the one that the
    options ask for, or with ``auto`` the first that loads in a worker, whose name
    and reason ``engine`` and ``engine_reason`` tell.  A worker makes it once.
    """
    by_model = options.vad == "silero"

    def engine() -> tuple[str | None, SpeechModel, str | None]:
        if not by_model or engines is None:
            return ("model" if by_model else None), model, None
        return once(f"speech_{options.vad_engine}_{'_'.join(engines)}", lambda: models.first_available(engines, options.vad_engine))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            used = reason = None
            for job, content in zip(pdf["job_index"], pdf["pcm"], strict=True):
                try:
                    if content is None or len(content) % 2:
                        raise ValueError("incomplete samples")
                    if most_seconds is not None and len(content) > 2 * intervals.SAMPLE_RATE * most_seconds:
                        raise ValueError(f"over the limit of {most_seconds} seconds")
                    pcm = np.frombuffer(content, "<i2").astype(np.float64)
                    used, speech_model, reason = engine()
                    segs, speech = recording_segments(pcm, options, speech_model)
                    own = []
                    for k, (a, b) in enumerate(segs):
                        inside = [{"start": max(a, s), "end": min(b, e)} for s, e in speech if e > a and s < b]
                        # seconds stand for whole samples, which they can miss by a rounding error
                        first, end = (int(np.rint(x * intervals.SAMPLE_RATE)) for x in (a, b))
                        clip = content[2 * first : 2 * end]
                        if not clip:
                            raise ValueError(f"segment {k} has no samples")
                        own.append((job, k, a, b, inside, clip, None, used, reason))
                    rows += own
                except Exception as e:  # noqa: BLE001 - a recording's failure is its own
                    rows.append((job, None, None, None, None, None, f"{type(e).__name__}: {e}", None, None))
            yield pd.DataFrame(rows, columns=["job_index", "segment_index", "start", "end", "speech", "clip", "error", "engine", "engine_reason"]).astype({"segment_index": "Int64"})

    return recordings.select("job_index", "pcm").mapInPandas(run, SEGMENT)


def aligned(texts: DataFrame, emissions: Callable[[np.ndarray], np.ndarray], ids: dict[str, int], stride_ms: float) -> DataFrame:
    """Recognised segments with ``aligned``, their words placed by an emission model's scores of their clips."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for clip, text, a, b in zip(pdf["clip"], pdf["transcript"], pdf["start"], pdf["end"], strict=True):
                words = [] if clip is None or not text or not text.strip() else align.segment_words(emissions(np.frombuffer(clip, "<i2").astype(np.float64)), text, a, b, ids, stride_ms)
                rows.append([{"word": w, "word_start": s, "word_end": e, "timing_source": source} for w, s, e, source in words])
            yield pdf.assign(aligned=rows)

    return texts.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in texts.dtypes) + f", aligned {ALIGNED}")


@dataclass(frozen=True)
class Run:
    """The results of a run: ``job_index, path, status, text, duration, segments, words, cues, error``; :meth:`ordered` has them in the order of their inputs."""

    options: Options
    results: DataFrame
    recognised: DataFrame | None = None
    seen: dict[str, Any] | None = None

    def checkpoints(self) -> DataFrame:
        """``(path, state)``: recognised texts of each recording without an error, as envelopes that :func:`state.read_checkpoints` opens for a later run."""
        whole = self.results.filter("error is null and status != 'skipped'").select("job_index", "path", "digest", "asr_key")
        parts = self.recognised.filter("segment_index is not null").groupBy("job_index").agg(F.array_sort(F.collect_list(F.struct("segment_index", "start", "end", "speech", "text"))).alias("segments"))
        rows = whole.join(parts, "job_index", "left").select("path", "digest", "asr_key", F.coalesce("segments", F.expr(f"cast(array() as {state.SEGMENTS})")).alias("segments"))
        return state.stored_checkpoints(rows)

    def ordered(self) -> DataFrame:
        return self.results.orderBy("job_index")

    def with_status(self, status: str) -> DataFrame:
        return self.results.filter(F.col("status") == status)

    @property
    def successful(self) -> DataFrame:
        return self.with_status("completed")

    @property
    def failed(self) -> DataFrame:
        return self.with_status("failed")

    @property
    def skipped(self) -> DataFrame:
        return self.with_status("skipped")

    def ok(self) -> bool:
        return self.failed.isEmpty()

    def single(self):
        """The only result."""
        two = self.results.limit(2).collect()
        if len(two) != 1:
            raise ValueError(f"expected one recording, found {'none' if not two else 'several'}")
        return two[0]

    def statistics(self, elapsed: float) -> DataFrame:
        return stats.run_statistics(self.results, elapsed)

    def profile(self, elapsed: float) -> DataFrame:
        """One row: :meth:`statistics`, and what was observed while the segments were written, with quantiles of their lengths."""
        totals = self.statistics(elapsed).first().asDict()
        return profile.segment_profile(self.recognised, self.seen).select(*(F.lit(v).alias(k) for k, v in totals.items()), "*")

    def batches(self) -> DataFrame:
        """``(rows, valid, padded, failures, seconds, padding)`` of each batch of the recogniser that succeeded; frames are of 20 ms."""
        return profile.batch_log(self.recognised)

    def recordings(self) -> DataFrame:
        """``(job_index, path, status, duration, segment_count, speech_span_count, speech_seconds, selected_seconds, engine, engine_reason, restored, error)`` of each recording."""
        spans = F.coalesce("speech", F.array().cast("array<struct<start:double,end:double>>"))
        seconds = F.aggregate(spans, F.lit(0.0), lambda t, s: t + s["end"] - s["start"])
        per = self.recognised.filter("segment_index is not null").groupBy("job_index").agg(F.count("*").alias("segment_count"), F.sum(F.size(spans)).alias("speech_span_count"), F.sum(seconds).alias("speech_seconds"), F.sum("duration").alias("selected_seconds"), F.max("engine").alias("engine"), F.max("engine_reason").alias("engine_reason"), F.bool_or("restored").alias("restored"))
        none = {"segment_count": 0, "speech_span_count": 0, "speech_seconds": 0.0, "selected_seconds": 0.0, "restored": False}
        rows = self.results.select("job_index", "path", "status", "duration", "error").join(per, "job_index", "left").fillna(none)
        return rows.select("job_index", "path", "status", "duration", *per.columns[1:], "error")

    def write_profile(self, root: str, elapsed: float) -> DataFrame:
        """Publish ``profile.json`` into a folder of its own: the options, the run's row, and no more than that, however long the run was."""
        row = self.profile(elapsed)
        body = F.struct(F.lit(1).alias("schema_version"), F.from_json(F.lit(json.dumps(self.options.settings())), F.schema_of_json(F.lit(json.dumps(self.options.settings())))).alias("configuration"), F.struct(*row.columns).alias("run"))
        text = text_ops.pretty_text(F.to_json(body, {"ignoreNullFields": "false"}))
        return publish(row.select(F.lit("profile").alias("job"), F.lit("profile.json").alias("name"), text.alias("content")), root, ())

    def documents(self) -> DataFrame:
        """``(job_index, path, txt, srt, vtt, json)``: rendered texts of completed results, those of the options' formats."""
        done = self.successful
        cues = done.select("job_index", F.posexplode("cues").alias("cue_index", "c")).select("job_index", F.col("cue_index").cast("long").alias("cue_index"), "c.start", "c.end", "c.text")
        out = done.select("job_index", "path", cue_ops.plain_text(F.transform("segments", lambda s: s["text"])).alias("txt"))
        if "srt" in self.options.formats:
            out = out.join(cue_ops.srt(cues, "job_index"), "job_index", "left").withColumn("srt", F.coalesce("srt", F.lit("")))
        if "vtt" in self.options.formats:
            out = out.join(cue_ops.vtt(cues, "job_index"), "job_index", "left").withColumn("vtt", F.coalesce("vtt", F.lit("WEBVTT\n\n")))
        if "json" in self.options.formats:
            kept = F.filter("segments", lambda s: F.trim(s["text"]) != "")
            body = F.struct(F.lit(1).alias("schema_version"), "path", F.col("duration").alias("duration_seconds"), F.lit(self.options.language).alias("language"), F.lit(self.options.vad).alias("segmentation"), F.lit(self.options.alignment).alias("timing"), kept.alias("segments"), "words", "cues")
            out = out.join(done.select("job_index", text_ops.pretty_text(F.to_json(body, {"ignoreNullFields": "false"})).alias("json")), "job_index")
        return out

    def publish(self, root: str) -> DataFrame:
        """Publish the documents below a folder that the executors share, each beside its recording's path; returns the manifest's rows of this run."""
        docs = self.documents().join(self.results.select("job_index", "digest", "asr_key", "render_key"), "job_index")
        stem = F.regexp_replace(F.ltrim("path", F.lit("/")), r"(?<=[^/])\.[^./]+$", "")
        each = F.array(*(F.struct(F.lit(f).alias("form"), F.col(f).alias("content")) for f in self.options.formats))
        files = docs.select(F.col("path").alias("job"), "path", "digest", "asr_key", "render_key", stem.alias("stem"), F.explode(each).alias("f"))
        return publish(files.select("job", "path", "digest", "asr_key", "render_key", F.concat("stem", F.lit("."), "f.form").alias("name"), "f.content"), root, ("path", "digest", "asr_key", "render_key"))

    def published(self, root: str) -> DataFrame:
        """``(path, digest, asr_key, render_key)`` of what is published below a folder: the manifest that :func:`transcribe` skips by."""
        rows = manifest(self.results.sparkSession, root)
        return rows.select(*(F.col("fields")[k].alias(k) for k in ("path", "digest", "asr_key", "render_key")))


def transcribe(recordings: DataFrame, options: Options, make: Callable[[], models.Recognizer] = models.StubRecognizer, model: SpeechModel = loudness, manifest: DataFrame | None = None, checkpoints: DataFrame | None = None, emissions: Callable[[np.ndarray], np.ndarray] | None = None, letters: dict[str, int] | None = None, stride_ms: float = 20.0, most_seconds: float | None = None, engines: dict[str, Callable[[], SpeechModel]] | None = None) -> Run:
    """Run over ``recordings(job_index, path, pcm)`` of 16-bit mono samples at 16 kHz.

    Word alignment needs ``emissions``, the scores (frames x labels, the star last)
    of a clip, and ``letters``, the columns of the labels; texts from checkpoints
    have no clips, and get uniform timing.  Longer recordings than ``most_seconds`` fail.
    ``engines`` make speech models by name, in place of ``model``, as in :func:`segmented`.

    ``manifest(path, digest, asr_key, render_key)`` names published results,
    which are skipped; ``checkpoints(path, digest, asr_key, segments)`` names
    recognised ones, whose texts are used again.
    """
    by_word = options.alignment == "word"
    if by_word and (emissions is None or letters is None):
        raise OptionError("alignment by word needs emissions and letters")
    scratch = Scratch(recordings.sparkSession, "transcribe")
    jobs = recordings.withColumn("digest", F.sha2("pcm", 256)).withColumn("asr_key", F.lit(options.asr_key())).withColumn("render_key", F.lit(options.render_key()))
    facts = jobs.select("job_index", "path", "digest", "asr_key", "render_key", (F.octet_length("pcm") / 2 / intervals.SAMPLE_RATE).alias("duration"))
    skipped = facts.limit(0) if manifest is None else state.verified(facts, manifest, ["path", "digest", "asr_key", "render_key"])
    todo = jobs if manifest is None else state.to_run(jobs, manifest, ["path", "digest", "asr_key", "render_key"])
    loaded = None
    if checkpoints is not None:
        same = ["path", "digest", "asr_key"]
        loaded = todo.select("job_index", *same).join(checkpoints.select(*same, "segments"), same).select("job_index", F.explode("segments").alias("s")).select("job_index", "s.*")
        todo = state.to_run(todo, checkpoints, same)
    cut = segmented(todo, options, model, most_seconds, engines).withColumnRenamed("error", "broken")
    frame = intervals.SAMPLE_RATE // 50
    texts = models.recognize(cut.withColumn("frames", F.expr(f"octet_length(clip) div {2 * frame}")), "clip", make, batch=options.batch_size, frames="frames")
    texts = aligned(texts, emissions, letters, stride_ms) if by_word else texts.withColumn("aligned", F.expr(f"cast(null as {ALIGNED})"))
    texts = texts.select("job_index", "segment_index", "start", "end", "speech", "aligned", F.col("transcript").alias("text"), F.coalesce("broken", F.when(F.col("segment_index").isNotNull(), F.col("error"))).alias("error"), F.lit(False).alias("restored"), "engine", "engine_reason", "batch")
    if loaded is not None:
        empty = {c: F.lit(None).cast(texts.schema[c].dataType) for c in ("error", "aligned", "engine", "engine_reason", "batch")}
        texts = texts.unionByName(loaded.withColumns(empty | {"restored": F.lit(True)}).select(texts.columns))
    # observed in the stage that writes
    texts, seen = profile.observed(texts.withColumn("duration", F.col("end") - F.col("start")), scratch, profile.segment_metrics())
    errors = texts.groupBy("job_index").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.coalesce("segment_index", F.lit(-1)))).alias("error"))
    good = texts.join(errors.filter("error is not null").select("job_index"), "job_index", "left_anti").filter("segment_index is not null")
    keys = ["job_index", "segment_index"]
    if options.alignment == "none":
        words = None
    else:
        placed = F.size(F.coalesce("aligned", F.array())) > 0
        by_model, good_rest = good.filter(placed), good.filter(~placed)
        spoken = good_rest.filter((F.size("speech") > 0) & (F.trim("text") != ""))
        spans = spoken.select(*keys, "text", F.posexplode("speech").alias("span_index", "p")).select(*keys, "text", "span_index", "p.start", "p.end")
        rest = good_rest.filter((F.size("speech") <= 0) & (F.trim("text") != ""))
        fields = [*keys, "word_index", "word", "word_start", "word_end", "timing_source"]
        across = timing.words_across_spans(spans, keys).withColumn("timing_source", F.lit("uniform_speech_spans" if options.vad_merge else "uniform_segment"))
        uniform = timing.uniform_words(rest.select(*keys, "text", "start", "end")).withColumn("timing_source", F.lit("uniform_segment"))
        words = across.select(fields).unionByName(uniform.select(fields))
        if by_word:
            each = by_model.select(*keys, F.posexplode("aligned").alias("word_index", "w")).select(*keys, "word_index", "w.*")
            words = words.withColumn("timing_source", F.lit("uniform_fallback")).unionByName(each.select(fields))
    ordered = lambda name, *fields: F.array_sort(F.collect_list(F.struct(*fields))).alias(name)
    parts = good.groupBy("job_index").agg(ordered("segments", "segment_index", "start", "end", "text"))
    out = facts.join(parts, "job_index", "left").join(errors, "job_index", "left").join(skipped.select("job_index", F.lit(True).alias("skip")), "job_index", "left")
    if words is not None:
        cues = cue_ops.extend_cues(cue_ops.build_cues(words, options.cue_limits(), "job_index").join(facts.select("job_index", "duration"), "job_index"), F.col("duration"), options.cue_limits(), "job_index")
        out = out.join(words.groupBy("job_index").agg(ordered("words", "segment_index", "word_index", F.col("word_start").alias("start"), F.col("word_end").alias("end"), F.col("word").alias("text"), "timing_source")), "job_index", "left")
        out = out.join(cues.groupBy("job_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("cue_index", "start", "end", "text"))), lambda c: F.struct(c["start"], c["end"], c["text"])).alias("cues")), "job_index", "left")
    else:
        out = out.withColumn("words", F.expr("cast(array() as array<struct<segment_index:bigint,word_index:int,start:double,end:double,text:string,timing_source:string>>)")).withColumn("cues", F.expr("cast(array() as array<struct<start:double,end:double,text:string>>)"))
    status = stats.status(F.coalesce("skip", F.lit(False)), F.col("error"))
    lines = F.filter(F.transform(F.coalesce("segments", F.expr("cast(array() as array<struct<segment_index:bigint,start:double,end:double,text:string>>)")), lambda s: F.trim(s["text"])), lambda t: t != "")
    text = F.when(status == "completed", F.array_join(lines, "\n"))
    full = lambda name: F.coalesce(name, F.array().cast(out.schema[name].dataType)).alias(name)
    return Run(options, out.select("job_index", "path", status.alias("status"), text.alias("text"), "duration", full("segments"), full("words"), full("cues"), "error", "digest", "asr_key", "render_key"), texts, seen)
