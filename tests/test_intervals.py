import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.operators import align, intervals


def test_merge_vector():
    s, e = np.array([0.2, 4.4, 15, 24.5]), np.array([4.0, 9.8, 24, 31])
    assert intervals.merge_sorted(s, e, 10, 1e-9) == [(0.2, 9.8), (15, 24), (24.5, 31)]
    with pytest.raises(ValueError, match="sorted and non-overlapping"):
        intervals.merge_sorted(np.array([0, 1]), np.array([2, 3]), 10)


def test_fixed_windows(spark):
    df = spark.createDataFrame([(65 * 16000 + 4000,), (0,), (5000,)], "n long")
    got = [(r.n, r.begin, r.end) for r in intervals.fixed_windows(df, "n", 480000).collect()]
    assert sorted(got) == [(5000, 0, 5000), (1044000, 0, 480000), (1044000, 480000, 960000), (1044000, 960000, 1044000)]
    assert intervals.fixed_windows(df.filter("n = 5000"), "n", 1001).count() == 5


def test_validate(spark):
    rows = [(1, 0.0, 0.7), (1, 0.5, 1.0), (2, -1.0, 0.5), (3, 0.2, 0.2), (3, 0.3, 2.0)]
    df = spark.createDataFrame(rows, "k int, s double, e double").selectExpr("*", "1.0D AS d")
    got = {(r.k, r.s): r.fault for r in intervals.validate_spans(df, "k", "s", "e", "d", 30.0).collect()}
    assert got == {(1, 0.0): None, (1, 0.7): "overlaps the span before", (2, 0.0): "outside the media", (3, 0.3): "outside the media"}


def plain_hysteresis(p, n, h):
    """The state machine stated once more, with flags instead of optional marks."""
    talking, begin, hush, out, silences = False, 0, -1, [], []
    limit = h.max_speech - 512 - 2 * h.pad
    for i, x in enumerate(p):
        t = 512 * i
        if x >= h.threshold and hush >= 0:
            if t - hush > h.cut_silence:
                silences.append((hush, t - hush))
            hush = -1
        if x >= h.threshold and not talking:
            talking, begin = True, t
            continue
        if talking and t - begin > limit:
            if silences:
                best = max(silences, key=lambda q: q[1])
                out.append([begin, best[0]])
                begin, hush, silences = sum(best), -1, []
            else:
                out.append([begin, t])
                talking, hush = False, -1
                continue
        if talking and x < h.exit_below:
            hush = t if hush < 0 else hush
            if t - hush >= h.min_silence:
                if hush - begin > h.min_speech:
                    out.append([begin, hush])
                talking, hush, silences = False, -1, []
    if talking and n - begin > h.min_speech:
        out.append([begin, n])
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.floats(0, 1, width=32), max_size=181), st.sampled_from([30, 2, 1, 0.2]))
def test_hysteresis_against_plain(p, most):
    h = intervals.Hysteresis(min_speech=800, min_silence=1600, pad=0, max_speech=most * 16000)
    assert intervals.speech_spans(np.array(p), 512 * len(p), h) == [tuple(x) for x in plain_hysteresis(p, 512 * len(p), h)]


def test_hysteresis_rejects():
    h = intervals.Hysteresis()
    with pytest.raises(ValueError, match="frames"):
        intervals.speech_spans(np.zeros(3), 512, h)
    with pytest.raises(ValueError, match="between"):
        intervals.speech_spans(np.array([1.1]), 512, h)


def test_padding_shares_short_gaps():
    assert intervals.padded([(1000, 2000), (2500, 3000)], 3100, 480) == [(520, 2250), (2250, 3100)]
    assert intervals.padded([(1000, 2000), (4000, 5000)], 9000, 480) == [(520, 2480), (3520, 5480)]


def test_energy():
    rate = 16000
    x = np.zeros(rate)
    x[int(0.2 * rate) : int(0.7 * rate)] = 0.5 * 32767 * np.sin(2 * np.pi * 440 * np.arange(int(0.5 * rate)) / rate)
    ((a, b),) = intervals.energy_spans(x)
    assert abs(a - 0.2) < 0.06 and abs(b - 0.7) < 0.06


def brute_path(scores, targets):
    """The best score over all frame labelings that spell the targets."""
    import itertools

    best = -np.inf
    for labels in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        spelt = [k for k, _ in itertools.groupby(labels) if k]
        if spelt == targets:
            best = max(best, sum(scores[t, k] for t, k in enumerate(labels)))
    return best


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.lists(st.integers(1, 2), min_size=1, max_size=3))
def test_best_path(seed, targets):
    scores = np.random.default_rng(seed).normal(size=(6, 3))
    path = align.best_path(scores, targets)
    assert [r[0] for r in align.runs(path) if r[0]] == targets
    assert np.isclose(sum(scores[t, k] for t, k in enumerate(path)), brute_path(scores, targets))


def test_token_spans():
    runs = [(0, 0, 3), (1, 4, 5), (0, 6, 9), (2, 10, 10), (0, 11, 12)]
    assert align.token_spans(runs, [1, 1]) == [(0, 7), (7, 12)]
    assert align.word_times([(0, 7), (7, 12)], 20) == [(0.0, 0.16), (0.16, 0.26)]
    with pytest.raises(ValueError):
        align.token_spans(runs, [1])


def test_stitching():
    window, context, ratio = 10, 2, 320
    n = 16 * 320 - 100
    outputs = [np.full((14, 3), k, float) for k in range(2)]
    got = align.stitched(n, outputs, window, context, ratio)
    assert got.shape == (-(-n // ratio), 4) and (got[:, 3] == 0).all() and got[9, 0] == 0 and got[10, 0] == 1


def plain_path(scores, targets):
    """The table stated plainly: a path stays, else takes one step, else passes over a blank, on a tie in that order."""
    labels = [0, *(x for t in targets for x in (t, 0))]
    best, back = [scores[0][0], scores[0][labels[1]], *[-np.inf] * (len(labels) - 2)], []
    for row in scores[1:]:
        ways = [(best[s], best[s - 1] if s else -np.inf, best[s - 2] if s > 2 and s % 2 and labels[s] != labels[s - 2] else -np.inf) for s in range(len(labels))]
        back.append([w.index(max(w)) for w in ways])
        best = [max(w) + row[x] for w, x in zip(ways, labels, strict=True)]
    at = len(labels) - 1 if best[-1] >= best[-2] else len(labels) - 2
    if not np.isfinite(best[at]):
        return None
    path = [labels[at]]
    for row in reversed(back):
        at -= row[at]
        path.append(labels[at])
    return path[::-1]


@pytest.mark.parametrize("cells", [1, 40, 1 << 12])
def test_best_paths_of_many(monkeypatch, cells):
    """Groups of paths of unlike sizes, with ties, doubled labels, labels that can't be and too few frames."""
    monkeypatch.setattr(align, "ROW_CELLS", cells)
    rng, items = np.random.default_rng(3), []
    for k in range(400):
        shape = rng.integers(1, 24), 4
        scores = rng.choice([0.0, -1.0, -9.0], shape) if k % 2 else rng.normal(size=shape)
        scores[rng.random(shape) < (0.2 if k % 5 == 0 else 0)] = -np.inf
        items.append((scores, rng.integers(1, 4, rng.integers(1, 12)).tolist()))
    got = [None if p is None else p.tolist() for p in align.best_paths(items)]
    assert got == [plain_path(*x) for x in items] and 40 < got.count(None) < 300


@pytest.mark.parametrize(("band", "cut"), [(64, 32), (64, 1), (64, 4), (5, 2)])
def test_best_paths_in_bands(monkeypatch, band, cut):
    """Paths that the scores spell more or less clearly, with a star, ties, doubled labels and frames that say something else, from narrow bands and from whole tables."""
    monkeypatch.setattr(align, "BAND", band)
    monkeypatch.setattr(align, "CUT", cut)
    whole, group = [], align._path_group
    monkeypatch.setattr(align, "_path_group", lambda items, blank: whole.extend(items) or group(items, blank))
    rng, items = np.random.default_rng(5), []
    for k in range(400):
        targets = rng.integers(1, 5, rng.integers(1, 16)).tolist()
        path = [x for t in targets for x in [t] * rng.integers(1, 4) + [0] * rng.integers(0, 3)]
        scores = np.full((len(path), 6), -9.0)
        scores[np.arange(len(path)), path] = 0.0
        scores[:, 5] = 0.0 if k % 2 else -9.0
        targets = [x for n, t in enumerate(targets) for x in ([5, t] if k % 2 and n % 4 == 0 else [t])]
        if k % 3 == 0:
            # sums of quarters are exact, so these are ties of whole paths
            scores[rng.random(scores.shape) < 0.2] = 0.0
            scores -= rng.integers(0, 2, scores.shape) * 0.25
        if k % 7 == 0:
            scores[rng.integers(len(path))] = -rng.integers(0, 4, 6)
        items.append((scores, targets))
    got = [None if p is None else p.tolist() for p in align.best_paths(items)]
    assert got == [plain_path(s, t) if len(t) <= len(s) else None for s, t in items] and got.count(None) < 200
    assert len(whole) < 350 and (band > 5 or len(whole) > 50)


def test_clear_speech_takes_no_square(monkeypatch):
    """An hour of speech, which spells 36,000 letters clearly but for one: its table would have five thousand million states."""

    def table(items, blank):
        raise AssertionError("every state is looked at")

    monkeypatch.setattr(align, "_path_group", table)
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice([*"abcdefgh"], rng.integers(1, 9))) for _ in range(8_000)]
    ids = {c: k + 1 for k, c in enumerate("abcdefgh")}
    path = [x for w in words for c in f"{w} " for x in ([ids[c], ids[c], 0] if c in ids else [0])]
    scores = np.full((len(path), 10), -9.0)
    scores[np.arange(len(path)), path] = 0.0
    scores[path.index(3), 3] = -0.5
    scores[:, 9] = 0.0
    got = align.segment_words(scores, " ".join(words), 100.0, 100.0 + len(path) * 0.02, ids, 20.0)
    assert [w[0] for w in got] == words and {w[3] for w in got} == {"ctc"}
    at = 0
    for w, (_, start, end, _) in zip(words, got, strict=True):
        # a star before each word takes some of the blanks between
        assert 100 + (at - 2.5) * 0.02 < start < end < 100 + (at + 3 * len(w) + 2.5) * 0.02
        at += 3 * len(w) + 1


def test_scores_are_held_by_cells(monkeypatch):
    monkeypatch.setattr(align, "HELD", 100)
    rows = [("job", k, "x" * n, 0.0, 1.0) for k, n in enumerate([1, 4, 5, 10, 11, 300, 2])]
    parts = list(align._parts(rows, lambda text, start, end: np.zeros((len(text), 10))))
    assert [[x[1] for x in part] for part in parts] == [[0, 1, 2], [3], [4], [5], [6]]
    assert [(*x[:2], *x[3:]) for part in parts for x in part] == rows


def test_alignment_is_spread_over_tasks(spark):
    """A few small rows, each much work, are not left to one task."""
    from spanloom.plans import driver, results  # noqa: F401 - registers its queries

    words = driver.QUERIES["word_alignment"](spark, "/root/testdata/sf0.001")
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert len({r[0] for r in words.select(F.spark_partition_id()).distinct().collect()}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
