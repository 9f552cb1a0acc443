"""Operators made for any size of group: interval joins, quantiles by selection and bootstrap intervals, against plain statements."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import intervals, stats
from spanloom.plans import driver, media, results  # noqa: F401 - registers its queries
from spanloom.sources.scratch import Scratch


def test_overlaps_of_a_hot_key(spark):
    """One key with most rows, spans of very unlike lengths, touching and empty ones, nulls; doubles and integers."""
    rng = random.Random(5)
    a, b = [], []
    for out, n in ((a, 400), (b, 300)):
        for k in range(n):
            s = rng.randrange(0, 5000)
            out.append(("hot" if k % 10 else f"k{k % 7}", k, s, s + rng.choice([0, 1, 3, 10, 10, 400])))
    a += [("hot", 1000, 0, 6000), ("hot", 1001, None, 5), (None, 1002, 0, 9)]
    want = sorted((x[1], y[1], max(x[2], y[2]), min(x[3], y[3])) for x in a for y in b if x[0] == y[0] and None not in x and x[3] > x[2] and y[3] > y[2] and x[3] > y[2] and x[2] < y[3])
    for kind in ("long", "double"):
        cast = float if kind == "double" else int
        row = lambda x: (*x[:2], *(None if v is None else cast(v) for v in x[2:]))  # noqa: B023, E731
        left = spark.createDataFrame([row(x) for x in a], f"job string, i long, s {kind}, e {kind}")
        right = spark.createDataFrame([row(x) for x in b], f"job string, j long, start_ms {kind}, end_ms {kind}")
        for width in (None, 1.0, 7.3, 1e6):
            got = intervals.clip_spans(left, right, width=width).select("i", "j", "s", "e").collect()
            assert sorted(tuple(r) for r in got) == want
    assert intervals.clip_spans(left.limit(0), right).count() == 0


def test_overlaps_cost_no_square_of_a_key(spark):
    """60,000 and 60,000 spans of one key, each overlapping one or two: the join's rows stay near the pairs found."""
    n = 60_000
    left = spark.range(n).select(F.lit(1).alias("job"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 9).alias("e"))
    right = spark.range(n).select(F.lit(1).alias("job"), (F.col("id") * 10 + 5).alias("start_ms"), (F.col("id") * 10 + 12).alias("end_ms"))
    assert intervals.clip_spans(left, right).count() == 2 * n - 1
    width = 8.0
    per = right.select(F.explode(F.sequence(F.floor(F.col("start_ms") / width), F.floor(F.col("end_ms") / width))).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
    assert per <= 3


@pytest.mark.parametrize("bound", [1, 10**6])
def test_quantiles_by_selection(spark, bound):
    """Groups of one value and of many, ties, negative and huge values, infinities, nulls, and a null group, whatever may be sorted at once."""
    rng = np.random.default_rng(7)
    groups = {"one": [3.25], "same": [1.5] * 400, "wide": (rng.standard_normal(700) * 10.0 ** rng.integers(-300, 300, 700)).tolist(), None: rng.integers(-5, 5, 333).astype(float).tolist(), "odd": [-math.inf, -0.0, 0.0, 5e-324, math.inf], "near": (1.0 + np.arange(900) * 2.0**-52).tolist()}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probabilities = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {r.g: r for r in stats.selected(df, "v", ["g"], probabilities, Scratch(spark, "test"), bound).select("g", "rows", "min", "max", F.array(*map(stats.interpolated, probabilities)).alias("q")).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        values = sorted(values)
        assert (got[g].rows, got[g].min, got[g].max) == (len(values), values[0], values[-1])
        for p, q in zip(probabilities, got[g].q, strict=True):
            x = p * (len(values) - 1)
            low, high = values[math.floor(x)], values[math.ceil(x)]
            want = low if math.floor(x) == math.ceil(x) else (math.ceil(x) - x) * low + (x - math.floor(x)) * high
            assert q == want or q == pytest.approx(want, rel=1e-12)


def test_quantiles_without_keys_or_rows(spark):
    df = spark.createDataFrame([(float(k),) for k in range(101)], "v double")
    assert tuple(stats.quantiles(df, "v").first()) == (0.0, 50.0, 90.0, 99.0, 100.0)
    assert stats.quantiles(spark.createDataFrame([("a", None)], "g string, v double"), "v", "g").collect() == []


def test_multiplicities_are_poisson(spark):
    n, reps = 400, 500
    words = spark.range(n).select(*stats.cluster_words(F.concat(F.lit("c"), F.col("id")))).toPandas()
    m = stats.multiplicities(words["w0"].to_numpy(), words["w1"].to_numpy(), reps)
    share = np.bincount(m.ravel(), minlength=5)[:5] / m.size
    assert np.abs(share - np.exp(-1) / np.array([1, 1, 2, 6, 24])).max() < 0.004
    # neither clusters nor replicates go together
    for x in (m, m.T):
        c = np.corrcoef(x)[np.triu_indices(len(x), 1)]
        assert abs(c.mean()) < 0.002 and c.std() < 1.1 / x.shape[1] ** 0.5


def test_bootstrap_covers_what_plain_resampling_covers(spark):
    """The interval of a multinomial bootstrap in numpy, by group, and clusters that hold together."""
    rng = np.random.default_rng(3)
    rows = []
    for g in ("x", "y"):
        for c in range(150):
            bias = rng.normal(0, 0.05)
            rows += [(g, f"{c}", 20, int(rng.binomial(20, np.clip(0.3 + bias, 0, 1))), int(rng.binomial(20, 0.25 if g == "x" else 0.3))) for _ in range(int(rng.integers(1, 6)))]
    df = spark.createDataFrame(rows, "g string, c string, u int, a int, b int")
    got = {r.g: r for r in stats.bootstrap_interval(df, F.col("c"), "u", "a", "b", "g", replicates=2000).collect()}
    for g in ("x", "y"):
        sums = {}
        for h, c, *v in rows:
            if h == g:
                sums[c] = sums.get(c, 0) + np.array(v)
        s = np.array(list(sums.values()))
        d = []
        for _ in range(2000):
            u, a, b = s[rng.integers(0, len(s), len(s))].sum(0)
            d.append((a - b) / u)
        low, high = np.percentile(d, [2.5, 97.5])
        r = got[g]
        assert (r.clusters, r.units) == (150, s[:, 0].sum()) and r.difference == pytest.approx((s[:, 1].sum() - s[:, 2].sum()) / s[:, 0].sum(), abs=1e-8)
        assert r.low == pytest.approx(low, abs=0.15 * (high - low)) and r.high == pytest.approx(high, abs=0.15 * (high - low))
    assert got["x"].low > 0 and stats.bootstrap_interval(df.limit(0), F.col("c"), "u", "a", "b", "g").collect() == []
