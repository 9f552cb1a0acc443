import json

import numpy as np
import pytest

from spanloom.options import OptionError, Options
from spanloom.plans.transcribe import transcribe


def tone(*parts):
    """Samples of (seconds, loud) parts."""
    rate = 16000
    return np.concatenate([(10000 * np.sin(2 * np.pi * 440 * np.arange(int(s * rate)) / rate) if loud else np.zeros(int(s * rate))) for s, loud in parts]).astype("<i2").tobytes()


@pytest.fixture(scope="module")
def recordings(spark):
    rows = [(0, "a.wav", tone((1, 0), (2, 1), (1, 0), (1.5, 1), (1, 0))), (1, "b.wav", b"\x00\x01\x02"), (2, "c.wav", tone((2, 0)))]
    return spark.createDataFrame(rows, "job_index long, path string, pcm binary")


def test_run(recordings):
    run = transcribe(recordings, Options(formats=("txt", "srt", "vtt", "json")))
    a, b, c = run.results.orderBy("job_index").collect()
    assert (a.status, b.status, c.status) == ("completed", "failed", "completed")
    assert len(a.segments) == 2 and len(a.words) == 8 and a.text.count("\n") == 1 and abs(a.segments[0].start - 1) < 0.1
    assert all(x.end <= y.start + 1e-9 for x, y in zip(a.words, a.words[1:], strict=False)) and a.cues[-1].end <= a.duration
    assert b.text is None and "incomplete" in b.error and c.text == "" and not run.ok()
    docs = {r.job_index: r for r in run.documents().collect()}
    assert set(docs) == {0, 2} and docs[0].srt.startswith("1\n00:00:0") and docs[2].vtt == "WEBVTT\n\n" and docs[2].txt == "\n"
    assert [s["segment_index"] for s in json.loads(docs[0].json)["segments"]] == [0, 1]
    s = run.statistics(2.0).first()
    assert (s.completed, s.failed, s.skipped) == (2, 1, 0) and s.real_time_factor == pytest.approx(8.5 / 2)
    with pytest.raises(ValueError, match="several"):
        run.single()


def test_skip_and_resume(recordings):
    options = Options(vad="none", max_dur=2.0)
    first = transcribe(recordings.filter("job_index != 1"), options)
    done = first.results.filter("job_index = 0").select("path", "digest", "asr_key", "render_key")
    held = first.results.filter("job_index = 2").selectExpr("path", "digest", "asr_key", "transform(segments, s -> struct(s.segment_index, s.start, s.end, cast(null as array<struct<start:double,end:double>>) AS speech, 'from a checkpoint' AS text)) AS segments")

    def unused():
        raise AssertionError("nothing is left to recognise")

    again = transcribe(recordings.filter("job_index != 1"), options, make=unused, manifest=done, checkpoints=held)
    a, c = again.results.orderBy("job_index").collect()
    assert a.status == "skipped" and c.status == "completed" and c.text == "from a checkpoint"


def test_word_alignment_in_a_run(recordings):
    letters = {c: k + 1 for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")}

    def emissions(pcm):
        return np.random.default_rng(len(pcm)).normal(size=(max(1, len(pcm) // 320), 28)) * (len(pcm) > 25_000)

    options = Options(alignment="word")
    with pytest.raises(OptionError, match="emissions"):
        transcribe(recordings, options)
    run = transcribe(recordings, options, emissions=emissions, letters=letters)
    a, b, c = run.ordered().collect()
    assert [r.job_index for r in (a, b, c)] == [0, 1, 2] and {w.timing_source for w in a.words} == {"ctc"}
    assert all(x.end <= y.start + 1e-9 for x, y in zip(a.words, a.words[1:], strict=False))
    assert [w.text for w in a.words] == " ".join(s.text for s in a.segments).split()
    short = transcribe(recordings, Options(), most_seconds=3.0).ordered().collect()
    assert [r.status for r in short] == ["failed", "failed", "completed"] and "over the limit" in short[0].error


def test_options():
    base = Options()
    assert base.formats == ("txt", "srt", "vtt") and Options(text_only=True).formats == ("txt",)
    assert base.asr_key() == base.but(max_chars=60).asr_key() and base.render_key() != base.but(max_chars=60).render_key()
    assert base.asr_key() != base.but(model="other").asr_key() and base.asr_key() == base.but(energy_threshold=10.0).asr_key()
    for bad in ({"vad": "x"}, {"text_only": True, "alignment": "word"}, {"formats": ()}, {"formats": ("doc",)}, {"min_dur": 40.0}, {"vad_threshold": 1.5}, {"max_gap": float("nan")}, {"batch_size": 0}, {"vad_merge": True, "vad": "none"}, {"max_retry_tokens": 4}, {"max_dur": 0.5, "vad": "none"}):
        with pytest.raises(OptionError):
            Options(**bad)


def test_clips_join_up_to_the_samples(spark):
    """Windows of a number of samples that no second divides: each clip has exactly its samples."""
    import types

    import numpy as np

    from spanloom.plans import transcribe as plan

    pcm = np.arange(5_000, dtype="<i2").tobytes()
    recordings = spark.createDataFrame([(1, pcm), (2, b"")], "job_index long, pcm binary")
    for window in (1001, 333, 512):
        options = types.SimpleNamespace(vad="none", max_dur=window / 16_000)
        rows = sorted(plan.segmented(recordings, options).collect(), key=lambda r: r.segment_index)
        assert [len(r.clip) // 2 for r in rows] == [min(window, 5_000 - a) for a in range(0, 5_000, window)]
        assert b"".join(bytes(r.clip) for r in rows) == pcm and not any(r.error for r in rows)


def test_checkpoints_from_stored_text(spark, recordings, tmp_path):
    """Envelopes written by one run are read by the next, which recognises nothing again; broken ones are told and not used."""
    from pyspark.sql import functions as F

    from spanloom.operators import state

    options = Options(vad="none", max_dur=2.0)
    first = transcribe(recordings, options)
    first.checkpoints().write.parquet(str(tmp_path / "states"))
    stored = spark.read.parquet(str(tmp_path / "states"))
    good, bad = state.read_checkpoints(stored)
    assert {r.path for r in good.collect()} == {"a.wav", "c.wav"} and bad.count() == 0

    class Never:
        def __call__(self, items):
            raise RuntimeError("recognised again")

    again = transcribe(recordings, options, make=Never, checkpoints=good)
    texts = lambda run: {r.path: (r.status, r.text) for r in run.results.collect()}
    assert texts(again) == texts(first) and texts(again)["a.wav"][0] == "completed"
    broken = stored.withColumn("state", F.when(F.col("path") == "a.wav", F.regexp_replace("state", "w[0-9]+", "other")).otherwise(F.col("state")))
    good, bad = state.read_checkpoints(broken)
    assert [r.path for r in good.collect()] == ["c.wav"] and [(r.path, r.fault) for r in bad.collect()] == [("a.wav", "state integrity check failed")]
    odd = [{"path": "x", "digest": "d", "asr_key": "k", "segments": s} for s in ([{"segment_index": 0, "start": 2.0, "end": 1.0, "speech": [], "text": "t"}], [{"segment_index": k, "start": 0.0, "end": 1.0, "speech": [], "text": "t"} for k in range(2)], None)] + [[1, 2], {"path": "x"}]
    good, bad = state.read_checkpoints(spark.createDataFrame([(str(k), state.envelope(x)) for k, x in enumerate(odd)], "name string, state string"))
    assert good.count() == 0 and {r.fault for r in bad.collect()} == {"checkpoint is not valid"} and bad.count() == 5
