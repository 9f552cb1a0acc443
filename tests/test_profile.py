"""The run's profile against plain sums over its rows; the engine chain; retries' own cap."""

import json

import numpy as np
import pytest
from compare import oracle_rows, spark_rows
from test_transcribe import recordings, tone  # noqa: F401 - a fixture

from spanloom.operators import models, profile
from spanloom.options import Options
from spanloom.plans import driver, results  # noqa: F401 - registers its queries
from spanloom.plans.transcribe import loudness, transcribe


def narrow():
    """A recogniser with memory for one item of a batch only; local, so that it is shipped by value."""

    class Narrow:
        def __call__(self, items):
            if len(items) > 1:
                raise MemoryError("too many")
            return [f"text {len(x)}" for x in items]

    return Narrow


def test_run_profile_sql(spark, sf):
    assert spark_rows(driver.QUERIES["run_profile"](spark, sf)) == oracle_rows(driver.ORACLE_SQL["run_profile"], sf)


def test_profile_of_a_run(spark, recordings, tmp_path):  # noqa: F811
    options = Options(vad="none", max_dur=1.0)
    run = transcribe(recordings.coalesce(1), options, make=narrow())
    rows = [r for r in run.recognised.collect() if r.segment_index is not None]
    lengths = [r.end - r.start for r in rows]
    p = run.profile(4.0).first()
    assert (p.results, p.completed, p.failed, p.real_time_factor) == (3, 2, 1, pytest.approx(8.5 / 4))
    assert (p.segments, p.inferred_segments, p.restored_segments, p.errors) == (len(rows), len(rows), 0, 1)
    # 9 items in one batch at first; halved until they are alone, which pads nothing
    assert (p.batches, p.batch_rows, p.least_batch, p.largest_batch, p.padding) == (9, 9, 1, 1, 0.0) and p.memory_failures == 3
    assert p.valid_frames == sum(round(50 * x) for x in lengths) == p.padded_frames
    want = dict(zip(("min", "p50", "p90", "p99", "max"), np.quantile(lengths, [0, 0.5, 0.9, 0.99, 1]), strict=True))
    assert all(p[f"{kind}_{q}"] == pytest.approx(v) for kind in profile.KINDS for q, v in want.items())
    log = run.batches().collect()
    assert len(log) == 9 and sum(r.failures for r in log) == 3 and all(r.padding == 0 and r.seconds >= 0 for r in log)
    files = {r.path: r for r in run.recordings().collect()}
    assert files["a.wav"].segment_count == 7 and files["a.wav"].selected_seconds == pytest.approx(6.5) and files["b.wav"].segment_count == 0 and files["b.wav"].error
    # nothing was inferred where all came from checkpoints
    held = run.checkpoints()
    from spanloom.operators import state

    again = transcribe(recordings, options, make=narrow(), checkpoints=state.read_checkpoints(held)[0])
    q = again.profile(1.0).first()
    assert (q.segments, q.inferred_segments, q.restored_segments, q.batches, q.padding, q.inferred_p50) == (9, 0, 9, 0, 0.0, None) and q.all_p50 == p.all_p50
    assert {r.path: r.restored for r in again.recordings().collect()} == {"a.wav": True, "b.wav": False, "c.wav": True}
    root = (tmp_path / "profile").as_uri()
    (told,) = run.write_profile(root, 4.0).collect()
    document = json.loads((tmp_path / "profile" / told.files[0].name).read_text())
    assert document["configuration"]["max_dur"] == 1.0 and document["run"]["batches"] == 9 and document["run"]["inferred_max"] == pytest.approx(1.0)


def test_profile_of_nothing(spark, recordings):  # noqa: F811
    p = transcribe(recordings.limit(0), Options()).profile(0.0).first()
    assert (p.results, p.segments, p.batches, p.padding, p.all_min, p.engines, p.least_batch, p.real_time_factor) == (0, 0, 0, 0.0, None, [], 0, 0.0)


def test_padding_of_batches(spark):
    """Each batch is as wide as its longest item; null items belong to none."""

    class Echo:
        def __call__(self, items):
            return items

    rows = [(k, None if k == 3 else f"t{k}", 10 * k) for k in range(8)]
    df = spark.createDataFrame(rows, "k long, item string, frames long").coalesce(1).sortWithinPartitions("k")
    got = models.recognize(df, "item", Echo, name="echo", batch=4, frames="frames").collect()
    assert [(r.k, r.transcript, r.error) for r in sorted(got)] == [(k, None if k == 3 else f"t{k}", None) for k in range(8)]
    assert {r.k: (r.batch.rows, r.batch.valid, r.batch.padded) for r in got if r.batch} == {0: (4, 70, 160), 5: (3, 180, 210)}


def missing(name):
    def make():
        raise models.EngineUnavailable(f"{name} is not installed")

    return make


def test_engine_chain(spark, recordings):  # noqa: F811
    engines = {"fast": missing("fast"), "plain": missing("plain"), "last": lambda: loudness}
    assert models.first_available(engines) == ("last", loudness, "fast: fast is not installed; plain: plain is not installed")
    assert models.first_available(engines, "last") == ("last", loudness, None)
    with pytest.raises(models.EngineUnavailable, match="fast is not"):
        models.first_available(engines, "fast")
    with pytest.raises(models.EngineUnavailable, match="fast.*; .*plain"):
        models.first_available({k: engines[k] for k in ("fast", "plain")})

    def broken():
        raise ValueError("a fault of its own")

    with pytest.raises(ValueError, match="own"):
        models.first_available({"broken": broken, **engines})
    run = transcribe(recordings, Options(), engines=engines)
    plain = transcribe(recordings, Options())
    assert [r.text for r in run.results.orderBy("job_index").collect()] == [r.text for r in plain.results.orderBy("job_index").collect()]
    p = run.profile(1.0).first()
    assert p.engines == ["last"] and p.engine_reasons == ["fast: fast is not installed; plain: plain is not installed"]
    only = transcribe(recordings, Options(vad_engine="plain"), engines=engines)
    assert {(r.path, r.error) for r in only.failed.collect()} >= {("a.wav", "EngineUnavailable: plain is not installed")}


def test_retries_have_their_own_cap():
    sizes, state = [], {}

    def run(items, limit):
        sizes.append((limit, len(items)))
        if limit > 100 and len(items) > 2:
            raise MemoryError
        return [(f"{x}", min(x, limit), x > limit) for x in items]

    items = [50, 150, 160, 170, 180, 190, 90]
    got = models.with_retries(run, items, 100, 896, state=state)
    assert [g["tokens"] for g in got] == items and [g["retried"] for g in got] == [x > 100 for x in items] and not any(g["limited"] for g in got)
    assert sizes[:3] == [(100, 7), (228, 5), (228, 2)] and state == {"retry_cap": 2}
    # the cap is kept, and the first run isn't cut by it
    sizes.clear()
    models.with_retries(run, items, 100, 896, state=state)
    assert sizes == [(100, 7), (228, 2), (228, 2), (228, 1)]

    def full(items, limit):
        if limit > 100:
            raise MemoryError("even one")
        return [("", limit, True) for _ in items]

    with pytest.raises(MemoryError, match="even one"):
        models.with_retries(full, [1, 2], 100, 896)
