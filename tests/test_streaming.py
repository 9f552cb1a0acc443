import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators.intervals import Hysteresis, speech_spans
from spanloom.streaming.sessions import stream_sessions
from spanloom.streaming.speech import SpeechMachine, stream_speech


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    last = events.agg(F.max("ts").alias("t")).first().t
    end = spark.createDataFrame([(-1, last)], "user_id long, ts timestamp").withColumn("ts", F.col("ts") + F.expr("interval 30 days"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stream_sessions(stream, "6 hours", "1 day").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.user_id, r.start, r.events) for r in spark.table("sessions").collect()}
    want = {(r.user_id, r.start, r.events) for r in stream_sessions(events, "6 hours", "1 day").collect()}
    assert got == want and len(want) > 10


def random_recordings(seed, jobs=12):
    rng = np.random.default_rng(seed)
    out = {}
    for job in range(jobs):
        n = int(rng.integers(0, 160))
        # stretches of speech and silence, with doubtful frames between
        level = np.repeat(rng.choice([0.02, 0.4, 0.95], n), rng.integers(1, 9, n))[:n]
        out[job] = (np.clip(level + rng.normal(0, 0.05, n), 0, 1), n * 512 - int(rng.integers(0, 512)) if n else 0)
    return out


CASES = [Hysteresis(min_speech=800, min_silence=1600), Hysteresis(min_speech=800, min_silence=3200, max_speech=16_000, pad=700), Hysteresis(max_speech=9_000, min_silence=4_000, min_speech=500, cut_silence=600)]


@pytest.mark.parametrize("h", CASES)
def test_machine_equals_all_frames_at_once(h):
    """Any cut into batches, any order, repeated rows, and a state that is written as text between batches."""
    rng = np.random.default_rng(4)
    for prob, samples in random_recordings(9, 60).values():
        rows = [(k, float(p), None) for k, p in enumerate(prob)] + [(len(prob), None, samples)]
        want = [(k, *s) for k, s in enumerate(speech_spans(prob, samples, h))]
        for mix in (False, True):
            order = rng.permutation(len(rows)) if mix else np.arange(len(rows))
            cuts = np.sort(rng.integers(0, len(rows) + 1, 4))
            held, got = None, []
            for part in np.split(order, cuts):
                machine = SpeechMachine(h, held)
                got += machine.rows([rows[k] for k in part] + [rows[k] for k in part[:1]])
                held = json.loads(json.dumps(machine.held))
            assert got == want and held["early"] == {} and held["ended"]


def test_stream_of_frames_through_a_restart(spark, tmp_path):
    """Files arrive one after the other, a third of them after the query was stopped and started again from its checkpoint."""
    h, data = CASES[1], random_recordings(3)
    rows = [(job, k, float(p), None) for job, (prob, _) in data.items() for k, p in enumerate(prob)] + [(job, len(prob), None, n) for job, (prob, n) in data.items()]
    random.Random(2).shuffle(rows)
    schema = "job long, frame long, prob double, samples long"
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def run():
        q = stream_speech(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), h).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None

    try:
        for part in (rows[: len(rows) // 3], rows[len(rows) // 3 : len(rows) // 2], rows[len(rows) // 2 :]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            run()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("job", "span_index", "s", "e").collect())
    want = sorted((job, k, *s) for job, (prob, n) in data.items() for k, s in enumerate(speech_spans(prob, n, h)))
    assert got == want and len(want) > 20


def test_machine_rejects():
    machine = SpeechMachine(CASES[0])
    with pytest.raises(ValueError, match="between"):
        list(machine.frame(1.5))
    with pytest.raises(ValueError, match="frames"):
        list(SpeechMachine(CASES[0]).end(513))
