import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.operators import cues, models, packing, state, stats, text, timing, tokens
from spanloom.sources import discovery


def test_largest_remainder(spark):
    df = spark.createDataFrame([(1, 0, 3, 1.0), (1, 1, 3, 1.0), (2, 0, 5, 0.0)], "k int, i int, n int, w double")
    got = {(r.k, r.i): r.share for r in timing.largest_remainder(df, ["k"], "n", "w", "i").collect()}
    assert got == {(1, 0): 2, (1, 1): 1, (2, 0): 0}


def test_words_across_spans(spark):
    df = spark.createDataFrame([(1, "one two three four", 0, 0.0, 1.0), (1, "one two three four", 1, 3.0, 4.0)], "k int, text string, span_index int, start double, end double")
    w = {r.word_index: r for r in timing.words_across_spans(df, ["k"]).collect()}
    assert w[1].word_end == 1.0 and w[2].word_start == 3.0 and [w[k].word for k in range(4)] == "one two three four".split()


def test_cue_vector(spark):
    limits = cues.CueLimits(100, 10, 0.5)
    got = cues.fold_cues([(-0.1, 0.1, "first"), (0.2, 0.4, "cue."), (1.5, 2.2, "last")], limits)
    assert got == [(0.0, 0.4, "first cue."), (1.5, 2.2, "last")]
    df = spark.createDataFrame([(1, k, *c) for k, c in enumerate(got)], "job int, cue_index long, start double, end double, text string")
    assert [(r.start, r.end) for r in cues.extend_cues(df, F.lit(2.0), limits).orderBy("cue_index").collect()] == [(0.0, 0.4), (1.5, 2.0)]


def test_cues_of_a_recording_longer_than_a_batch(spark):
    """The words of one recording fill whole Arrow batches, between recordings of a word or two."""
    words = [(0, 0, 0.0, 0.1, "a"), *((1, k, k * 0.3, k * 0.3 + 0.2, f"w{k}" + "." * (k % 17 == 16)) for k in range(100)), (2, 0, 0.0, 0.1, "b"), (2, 1, 0.2, 0.3, "c")]
    df = spark.createDataFrame(words, "job int, word_index int, word_start double, word_end double, word string").repartition(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "8")
    try:
        got = cues.build_cues(df, cues.CueLimits(), order=("word_index",)).collect()
    finally:
        spark.conf.set(key, before)
    want = [(job, k, *c) for job in (0, 1, 2) for k, c in enumerate(cues.fold_cues([w[2:] for w in words if w[0] == job], cues.CueLimits()))]
    assert sorted(map(tuple, got)) == want


def test_rendering(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 1.234, "a"), (1, 1, 3661.005, 3662.5, "b")], "job int, cue_index long, start double, end double, text string")
    assert cues.srt(df).first().srt == "1\n00:00:00,000 --> 00:00:01,234\na\n\n2\n01:01:01,005 --> 01:01:02,500\nb\n\n"
    assert cues.vtt(df).first().vtt == "WEBVTT\n\n00:00.000 --> 00:01.234\na\n\n01:01:01.005 --> 01:01:02.500\nb\n\n"
    lines = spark.createDataFrame([([" a ", " ", "b"],), ([],)], "l array<string>")
    assert [r[0] for r in lines.select(cues.plain_text(F.col("l"))).collect()] == ["a\nb\n", "\n"]


@given(st.lists(st.integers(1, 50), min_size=2, max_size=12))
def test_oom_split(d):
    d = sorted(d, reverse=True)
    cost = lambda i: max(i * d[0], (len(d) - i) * d[i])
    got = packing.oom_split(d)
    assert cost(got) == min(map(cost, range(1, len(d)))) and all(cost(i) > cost(got) for i in range(1, got))


def test_oom_split_of_costs_equal_but_for_rounding(spark):
    """5 * 316 and 2 * 790 are one cost, and so are 3 * 688 and 2 * 1032, whatever a unit of 0.06 makes of them."""
    rows = [[n * 0.06 for n in x] for x in ([790, 316, 272, 220, 166, 158], [1032, 688, 210, 66])]
    df = spark.createDataFrame([(x,) for x in rows], "x array<double>")
    assert [packing.oom_split(x) for x in rows] == [1, 1] == [r[0] for r in df.select(packing.oom_split_column(F.col("x"))).collect()]


def test_batches():
    assert packing.oom_split([30, 20, 10, 10, 10, 10]) == 2
    assert packing.next_fit([5, 5, 20, 1, 1, 1], 10, 2) == [0, 0, 1, 2, 2, 3]
    assert packing.take_batches([4.0] * 5, 2, 8.0) == [0, 0, 1, 1, 2]
    b = packing.BatchSize(4)
    b.failed(4)
    assert (b.current, b.most) == (2, 3)
    b = packing.BatchSize(24)
    b.succeeded(0.3)
    assert b.current == 30
    rounds = packing.pack_blocks([10, 7, 3], 4, 2, 7, 7)
    left = [0, 0, 0]
    for r in rounds:
        assert len(r) <= 2 and sum(n for _, n in r) <= 7 and len(r) * max(n for _, n in r) <= 7
        for k, n in r:
            left[k] += n
    assert left == [10, 7, 3]


def test_tokens(spark):
    rows = spark.createDataFrame([(0, [3, 2, 2][1:] and [10, 3, 2, 2]), (1, [20, 21, 22, 23]), (2, [30, 31, 2, 2])], "i int, g array<long>")
    got = {r.i: (r.a["count"], r.a["truncated"]) for r in rows.select("i", tokens.analyze(F.col("g"), 4, [3], 2, F.col("i") == 2).alias("a")).collect()}
    assert got == {0: (2, False), 1: (4, True), 2: (2, False)}
    loop = list(range(8)) * 12
    df = spark.createDataFrame([(loop,), (loop[:95],), (list(range(96)),), ([99] + loop,)], "a array<long>")
    assert [r[0] for r in df.select(tokens.repeats_at_end(F.col("a"))).collect()] == [True, False, False, True]
    assert [r[0] for r in df.select(tokens.repetition_point(F.col("a"), [99])).collect()] == [96, None, None, None]
    lim = lambda *x: spark.range(1).select(tokens.retry_limit(*map(F.lit, x))).first()[0]
    assert lim(100, 10, 70, 200) == 90 and lim(2000, 10, 445, 896) == 896


def test_failures(spark):
    df = spark.createDataFrame([("RuntimeError", "CUDA error: CUBLAS_STATUS_ALLOC_FAILED"), ("RuntimeError", "illegal memory access at 0xAB 12"), ("RuntimeError", ""), ("KeyError", "x")], "k string, m string")
    got = [tuple(r) for r in df.select(tokens.failure_class(F.col("k"), F.col("m")), tokens.failure_fingerprint(F.col("k"), F.col("m"))).collect()]
    assert [g[0] for g in got] == ["oom", "fatal", "error", "fatal"]
    assert got[1][1] == "RuntimeError: illegal memory access at 0x* #" and got[2][1] == "RuntimeError: <no message>"


def test_reassembly(spark):
    rows = [(1, 1, "second", 3), (1, 0, "first", 3), (1, 2, "", 3), (2, 0, "a", 2), (3, 0, "a", 2), (3, 0, "b", 2), (4, 5, "a", 2)]
    got = {r.j: (r.texts, r.fault) for r in tokens.reassemble(spark.createDataFrame(rows, "j int, i int, t string, n int"), "j", "i", "t", "n").collect()}
    assert got == {1: (["first", "second", ""], None), 2: (None, "missing"), 3: (None, "repeated"), 4: (None, "index outside")}


def test_isolation():
    log: list[int] = []

    def poison(items):
        if any(x < 3 for x in items):
            raise ValueError("bad")
        return [str(x) for x in items]

    got = models.isolated(poison, [0, 1, 2, 3, 4], log=log)
    assert [e is None for _, e in got] == [False, False, False, True, True] and log[-1] == 2

    def small(items):
        if len(items) > 6:
            raise MemoryError
        return [str(x) for x in items]

    log = []
    assert all(e is None for _, e in models.isolated(small, list(range(24)), log=log)) and log == [24, 12, 6, 6, 6, 6]

    def lost(items):
        raise SystemError("device gone")

    state = {}
    assert all("device gone" in e for _, e in models.isolated(lost, [1, 2, 3], state=state))
    # the breaker stays open
    assert all("device gone" in e for _, e in models.isolated(small, [1, 2], state=state))
    log = []
    got = models.isolated(small, list(range(9)), log=log, sizes=[9.0, 9, 1, 1, 1, 1, 1, 1, 1])
    assert all(e is None for _, e in got) and log[:2] == [9, 2]


def test_recognize(spark):
    df = spark.createDataFrame([(k, f"clip{k}") for k in range(50)], "i int, clip string")
    rows = models.recognize(df, "clip", models.StubRecognizer).collect()
    assert len(rows) == 50 and all(r.error is None and len(r.transcript.split()) == 4 for r in rows)


def test_envelope():
    good = state.envelope({"a": "é", "b": [1, 2.5]})
    assert state.open_envelope(good) == {"a": "é", "b": [1, 2.5]}
    bad = json.loads(good)
    with pytest.raises(state.StateError, match="schema is unsupported"):
        state.open_envelope(json.dumps(bad | {"schema_version": 999}))
    with pytest.raises(state.StateError, match="integrity check failed"):
        state.open_envelope(json.dumps(bad | {"payload": {}}))
    with pytest.raises(state.StateError, match="unreadable"):
        state.open_envelope(good[:-3])
    assert state.contract_key({"x": 1, "y": 2}) == state.contract_key({"y": 2, "x": 1})


def test_publish_rolls_back(tmp_path):
    a = tmp_path / "a.txt"
    a.write_text("old")
    with pytest.raises(OSError):
        state.publish({str(a): "new", str(tmp_path / "no/such/b"): "x"}, str(tmp_path / "m"), "{}")
    assert a.read_text() == "old" and not (tmp_path / "m").exists()
    state.publish({str(a): "new"}, str(tmp_path / "m"), "{}")
    assert a.read_text() == "new" and (tmp_path / "m").exists()

    def changed():
        raise state.StateError("source changed")

    with pytest.raises(state.StateError, match="source changed"):
        state.publish({str(a): "newer"}, str(tmp_path / "m"), "{}", check=changed)
    # a manifest that can't be put in place takes the files back
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x").write_text("")
    with pytest.raises(OSError):
        state.publish({str(a): "newest", str(tmp_path / "n"): "n"}, str(tmp_path / "d"), "{}")
    assert a.read_text() == "new" and not (tmp_path / "n").exists() and not list(tmp_path.glob(".publish-*"))


def test_vocabulary():
    from spanloom.operators import align

    ids, names, blank = align.vocabulary({"A": 1, "b": 2, "<pad>": 0}, 4)
    assert ids == {"a": 1, "b": 2, "<pad>": 0, "<star>": 3} and names[3] == "<star>" and blank == 0


def test_segment_words_fall_back():
    from spanloom.operators import align

    few = align.segment_words(np.zeros((1, 4)), "one two", 1.0, 3.0, {"o": 1}, 20.0)
    assert few == [("one", 1.0, 2.0, "uniform_fallback"), ("two", 2.0, 3.0, "uniform_fallback")]
    ids = {c: k + 1 for k, c in enumerate("abc")}
    scores = np.full((40, 5), -9.0)
    path = [0] * 4 + [1] * 4 + [2] * 4 + [0] * 8 + [3] * 4 + [0] * 16
    scores[np.arange(40), path] = 0
    scores[:, -1] = -0.1
    words = align.segment_words(scores, "ab c", 10.0, 10.8, ids, 20.0)
    assert [w for w, *_ in words] == ["ab", "c"] and {s for *_, s in words} == {"ctc"}
    (_, a0, a1, _), (_, c0, c1, _) = words
    assert 10.0 <= a0 <= 10.12 and a1 <= c0 and 10.2 <= c0 <= 10.42 and c1 <= 10.8
    # a label that nothing can spell in so few frames
    assert align.segment_words(scores[:2], "abcabc", 0.0, 1.0, ids, 20.0)[0][3] == "uniform_fallback"


def test_results_rules(spark):
    from pyspark.sql import functions as F

    from spanloom.operators import results

    df = spark.createDataFrame([(k, f"r{k}") for k in (3, 1, 4, 2, 0)], "job_index int, name string")
    assert [r.job_index for r in results.in_order(df).collect()] == [0, 1, 2, 3, 4]
    assert [r.name for r in results.sliced(df, 1, 3).collect()] == ["r1", "r2"] and results.sliced(df, 0, 9).count() == 5
    one = spark.range(1)
    version = lambda v: one.select(results.version_at_least(F.lit(v), 0, 14)).first()[0]
    assert [version(v) for v in ("0.13.9", "0.14.0+cu1", "1.0", "x", "")] == [False, True, True, False, False]
    assert one.select(results.default_batch(F.lit("cuda")), results.default_batch(F.lit("tpu"))).first()[:] == (24, 4)
    none = results.corpus_errors(spark.createDataFrame([], "units long, substitutions long, deletions long, insertions long")).first()
    assert (none.units, none.rate) == (0, None)


def test_discovery(tmp_path, spark):
    for n in (".hidden.ogg", "A first.mp3", "archive.tar.WAV", "z last.wav", "مرحبا.WEBM", "notes.txt"):
        (tmp_path / n).write_bytes(b"x")
    names = [r for _, r in discovery.expand_inputs([tmp_path, tmp_path / "A first.mp3"])]
    assert names == [".hidden.ogg", "A first.mp3", "archive.tar.WAV", "z last.wav", "مرحبا.WEBM"]
    assert discovery.expand_inputs(tmp_path / "notes.txt")[0][1] == "notes.txt"
    with pytest.raises(discovery.InputError):
        discovery.expand_inputs(tmp_path / "none")
    assert discovery.recordings(spark, str(tmp_path)).count() == 4  # Spark passes over hidden files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=6), st.lists(st.sampled_from("ab"), max_size=6))
def test_edit_counts(r, h):
    def cost(i, j):
        if not i or not j:
            return i or j
        return min(cost(i - 1, j) + 1, cost(i, j - 1) + 1, cost(i - 1, j - 1) + (r[i - 1] != h[j - 1]))

    s, d, n = stats.edit_counts(r, h)
    assert s + d + n == cost(len(r), len(h)) and len(r) - d + n == len(h)


def test_normalize(spark):
    df = spark.createDataFrame([("Ａｂ, c (take 2)  12 don’t مَرحبـا",)], "t string")
    assert df.select(text.normalized(F.col("t"))).first()[0] == "ab c don't مرحبا"
    assert text.pretty({"a": "é"}) == '{\n  "a": "é"\n}\n'
    with pytest.raises(ValueError):
        text.pretty({"a": float("nan")})


def test_statistics(spark):
    df = spark.createDataFrame([(10.0, False, None), (5.0, True, None), (3.0, False, "x")], "duration double, skipped boolean, error string")
    r = stats.run_statistics(df.withColumn("status", stats.status(F.col("skipped"), F.col("error"))), 2.0).first()
    assert (r.completed, r.failed, r.skipped, r.real_time_factor, r.ok) == (1, 1, 1, 5.0, False)
    assert stats.quantiles(df.filter("duration < 0"), "duration").first().p50 is None


def test_probe(spark):
    rows = ['{"streams":[{"duration":"N/A"},{"duration":"3.5"}],"format":{"duration":"9"}}', '{"streams":[{}],"format":{"duration":"9","start_time":"2"}}', '{"format":{"duration":"2","start_time":"5"}}', '{"format":{"duration":"-1"}}', "no json", None, '{"streams":[{"duration":"NaN"}]}']
    from spanloom.sources.probe import probed_duration

    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, j string")
    assert [r[0] for r in df.orderBy("k").select(probed_duration(F.col("j"))).collect()] == [3.5, 7.0, 2.0, None, None, None, None]


def test_short_duration(spark):
    df = spark.createDataFrame([(3723.5,), (123.0,), (2.5,), (-1.0,)], "s double")
    assert [r[0] for r in df.select(cues.short_duration(F.col("s"))).collect()] == ["1h02m04s", "2m03s", "2s", "0s"]


def test_retries():
    calls = []

    def run(items, limit):
        calls.append((list(items), limit))
        return [(f"t{x}", min(x, limit), x > limit) for x in items]

    out = models.with_retries(run, [10, 500, 5000], 445, 896)
    assert calls == [([10, 500, 5000], 445), ([500, 5000], 896)]
    assert [(o["tokens"], o["retried"], o["limited"]) for o in out] == [(10, False, False), (500, True, False), (896, True, True)]
    assert models.with_retries(run, [5000], 445, 896, "warn")[0]["limited"]


def test_batch_rollup(spark):
    df = spark.createDataFrame([(24, 100, 120, 50, False), (0, 0, 0, 0, False), (12, 40, 60, 20, False), (24, 100, 120, 0, True)], "rows int, frames int, padded int, tokens int, failed boolean")
    r = stats.batch_rollup(df).first()
    assert (r.batches, r.memory_failures, r.rows, r.frames, r.tokens, r.largest, r.least) == (3, 1, 36, 140, 70, 24, 12)


def test_first_loop_is_the_first_prefix_that_loops():
    rng = np.random.default_rng(8)

    def loops(t):
        return any(t[-p:] == t[-2 * p : -p] == t[-3 * p : -2 * p] == t[-4 * p : -3 * p] for p in range(8, min(32, len(t) // 4) + 1))

    for _ in range(120):
        t = rng.integers(0, 3, rng.integers(0, 130)).tolist()
        at = int(rng.integers(0, len(t) + 1))
        block = rng.integers(0, 3, rng.integers(6, 35)).tolist()
        t[at:at] = block * int(rng.integers(1, 8))
        want = next((m for m in range(96, len(t) + 1) if loops(t[:m])), None)
        assert tokens.first_loop(np.array(t, np.int64)) == want


def test_first_loop_of_long_rows_is_quick():
    import time

    began = time.perf_counter()
    t = np.arange(1_000_000)
    t[-400:] = np.tile(np.arange(20), 20)
    assert tokens.first_loop(t) == 1_000_000 - 400 + 80
    assert time.perf_counter() - began < 10


def test_loops_after_an_end_token_stop_nothing(spark):
    t = list(range(100)) + list(range(10)) * 6
    df = spark.createDataFrame([(1, t), (2, [*t[:99], 7777, *t[100:]]), (3, None), (4, [])], "i int, a array<long>")
    got = {r.i: r.p for r in df.select("i", tokens.repetition_point(F.col("a"), [7777]).alias("p")).collect()}
    assert got == {1: 140, 2: None, 3: None, 4: None}


def test_edit_counts_take_linear_space():
    """Two texts of 12,000 words: a table of one byte a cell would have 144 MB."""
    import tracemalloc

    rng = np.random.default_rng(4)
    a, b = ([f"w{x}" for x in rng.integers(0, 50, 12_000)] for _ in range(2))
    tracemalloc.start()
    (s, d, i) = stats.edit_counts_of([(a, b)])[0].tolist()
    assert tracemalloc.get_traced_memory()[1] < 30_000_000 and d == i and 0 < s + d + i < 12_000
    tracemalloc.stop()


def test_casefold_orders_locks(spark):
    from spanloom.operators import results

    rows = [(1, "STRASSE", 0), (2, "straße", 1), (3, "strasse", 2), (4, "Ärger", 0), (5, "a", 9)]
    df = spark.createDataFrame(rows, "i int, path string, off int").withColumn("g", F.lit(1))
    got = [r.i for r in results.lock_order(df, "path", "off", "path", "g").orderBy("turn").collect()]
    assert got == [i for i, p, o in sorted(rows, key=lambda r: (r[1].casefold(), r[2], r[1].casefold()))] == [5, 1, 2, 3, 4]


def test_apostrophes_of_long_words(spark):
    """The last quote that has a sign on both sides; a word of many quotes takes no square of its length."""
    import re

    words = ["don\u2019t", "\u2019a\u2019", "a\u2019b\u2018c\u201b", "a\u2019\u2019", "\u2019", "x\u2019\u2019\u2019y\u2018\u2018", "a\u2019b \u2019c d\u2019"]
    rng = np.random.default_rng(9)
    words += ["".join(rng.choice(list("ab\u2019\u2018 "), rng.integers(1, 12))) for _ in range(200)]
    from spanloom.operators import text

    # punctuation goes after this step, so only apostrophes that it made are left
    want = [re.sub("[\u2018\u2019\u201b]", " ", re.sub(r"(\S+)[\u201b\u2019\u2018](\S+)", r"\1'\2", w)).split() for w in words]
    df = spark.createDataFrame(list(enumerate([*words, "\u2019a" * 200_000])), "i int, t string")
    got = [r.n for r in df.orderBy("i").select(text.normalized(F.col("t")).alias("n")).collect()]
    assert [g.split() for g in got[:-1]] == want and got[-1].endswith("a'a")
