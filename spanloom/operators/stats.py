"""Run statistics, roll-ups and scoring."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import Scratch


def status(skipped: Column, error: Column) -> Column:
    """skipped before failed before completed."""
    return F.when(skipped, "skipped").when(error.isNotNull(), "failed").otherwise("completed")


def run_statistics(results: DataFrame, elapsed: float) -> DataFrame:
    """One row: counts by status, audio seconds of completed results, and seconds of audio a second (0 without time)."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    audio = F.coalesce(F.sum(F.when(F.col("status") == "completed", F.col("duration"))), F.lit(0.0))
    rate = audio / elapsed if elapsed > 0 else F.lit(0.0)
    return results.agg(F.count("*").alias("results"), count("completed"), count("failed"), count("skipped"), F.round(audio, 6).alias("audio_seconds"), F.round(rate, 6).alias("real_time_factor"), (F.count_if(F.col("status") == "failed") == 0).alias("ok"))


def padding_ratio(items: DataFrame, batch: list[str], frames: str) -> DataFrame:
    """One row: valid and padded frames over all batches, and the share of padding (0 without any)."""
    per = items.groupBy(*batch).agg(F.sum(frames).alias("valid"), (F.count("*") * F.max(frames)).alias("padded"))
    valid, padded = F.coalesce(F.sum("valid"), F.lit(0)), F.coalesce(F.sum("padded"), F.lit(0))
    return per.agg(F.count("*").alias("batches"), valid.alias("valid"), padded.alias("padded"), F.round(F.when(padded > 0, 1 - valid / padded).otherwise(0.0), 9).alias("padding"))


#: Rows of a group that one sort may hold when ranks are looked for.
SORTED = 1_000_000


def ordered_bits(value: Column) -> Column:
    """A double as 64 bits whose order as an unsigned number is that of the values."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value).cast("long")
    return F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(1 << 63))))


def selected(df: DataFrame, value: str, keys: list[str], probabilities: list[float], scratch: Scratch, bound: int = SORTED) -> DataFrame:
    """``(*keys, rows, min, max, ranked)`` with ``ranked`` a map from rank to value, for the ranks that the probabilities lie between.

    Ranks are found digit by digit: a histogram over the leading bits, then
    over the next ones of only those rows whose leading bits hold a wanted
    rank, until the rows left of each group are few enough to be sorted.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).filter("v is not null").withColumn("b", ordered_bits(F.col("v")))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    shift, width = 64, 20
    first = rows.groupBy(*keys, F.shiftrightunsigned("b", 44).alias("d")).agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"))
    first = scratch.save(first)
    groups = first.groupBy(*keys).agg(F.sum("n").alias("rows"), F.min("min").alias("min"), F.max("max").alias("max"))
    places = F.array(*(F.lit(float(p)) * (F.col("rows") - 1) for p in probabilities))
    ranks = F.array_distinct(F.flatten(F.transform(places, lambda x: F.array(F.floor(x), F.ceil(x)))))
    # the histogram of a prefix takes the place of its rows, rank by rank
    wanted = scratch.save(groups.select(*keys, F.explode(ranks).alias("rank")).withColumn("rest", F.col("rank")).withColumn("p", F.lit(0).cast("long")))
    counts = first.select(*keys, F.lit(0).cast("long").alias("p"), "d", "n")
    while True:
        before = F.sum("n").over(Window.partitionBy(*keys, "p").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        bins = counts.withColumn("before", before)
        holds = [F.col("l.p") == F.col("r.p"), F.col("l.rest") >= F.col("before"), F.col("l.rest") < F.col("before") + F.col("n")]
        shift -= width
        found = wanted.alias("l").join(bins.alias("r"), _all([*same, *holds]))
        wanted = scratch.save(found.select(*(F.col(f"l.{k}").alias(k) for k in keys), "l.rank", (F.col("l.rest") - F.col("before")).alias("rest"), F.shiftleft(F.col("l.p"), width).bitwiseOR(F.col("r.d")).alias("p"), "n"))
        most = wanted.agg(F.max("n")).first()[0]
        inside = rows.alias("l").join(wanted.select(*keys, "p").distinct().alias("r"), _all([*same, F.shiftrightunsigned("l.b", shift) == F.col("r.p")]), "left_semi")
        if not shift or most is None or most <= bound:
            break
        width = min(22, shift)
        digit = F.shiftrightunsigned("b", shift - width).bitwiseAND(F.lit((1 << width) - 1))
        counts = scratch.save(inside.groupBy(*keys, F.shiftrightunsigned("b", shift).alias("p"), digit.alias("d")).agg(F.count("*").alias("n")))
        wanted = wanted.drop("n")
    # equal values are one row, so a prefix of all bits needs no sort
    last = inside.groupBy(*keys, F.shiftrightunsigned("b", shift).alias("p") if shift else F.col("b").alias("p"), "v").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys, "p").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    holds = [F.col("l.p") == F.col("r.p"), F.col("l.rest") >= F.col("before"), F.col("l.rest") < F.col("before") + F.col("r.n")]
    values = wanted.alias("l").join(last.withColumn("before", before).alias("r"), _all([*same, *holds])).select(*(F.col(f"l.{k}").alias(k) for k in keys), "l.rank", "r.v")
    ranked = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("ranked"))
    if not keys:
        return groups.join(F.broadcast(ranked))
    return groups.alias("l").join(ranked.alias("r"), _all(same)).select("l.*", "ranked")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def interpolated(probability: float) -> Column:
    """The quantile between the two ranked values that it lies between, of the rows of :func:`selected`."""
    place = F.lit(float(probability)) * (F.col("rows") - 1)
    low, high = (F.element_at("ranked", f(place)) for f in (F.floor, F.ceil))
    return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)


def quantiles(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """min, p50, p90, p99 and max with linear interpolation; groups without values have no row."""
    got = selected(df, value, list(keys), [0.5, 0.9, 0.99], Scratch(df.sparkSession, "quantiles"))
    return got.select(*keys, "min", *(F.round(interpolated(p), 9).alias(n) for n, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))), "max")


#: Fixed values of a 32-bit hash: multipliers whose products stay below 2**63.
MIXERS = (0x21F0AAAD, 0x735A2D97)
#: Poisson(1) by a 32-bit number: a cluster is drawn once more at each of these.
POISSON = [round(sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) * (1 << 32)) for n in range(12)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash of 32-bit numbers, in 64-bit arithmetic that any engine has."""
    for multiplier, shift in zip(MIXERS, (16, 15), strict=True):
        x = (x ^ (x >> shift)) * multiplier % (1 << 32)
    return x ^ (x >> 15)


def cluster_words(cluster: Column) -> list[Column]:
    """Two 32-bit numbers ``w0, w1`` that stand for a cluster."""
    digest = F.md5(cluster.cast("string"))
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"w{k}") for k in range(2)]


def multiplicities(w0: np.ndarray, w1: np.ndarray, replicates: int, seed: int = 0) -> np.ndarray:
    """How often each replicate (column) draws each cluster (row): Poisson(1) numbers from a hash of both, so that no draw is stored."""
    x = mixed((w0[:, None] + np.arange(replicates) * 2654435769 + seed) % (1 << 32))
    return np.searchsorted(POISSON, mixed(x ^ w1[:, None]), side="right")


def replicate_sums(sums: DataFrame, keys: list[str], replicates: int, seed: int, block: int = 128) -> DataFrame:
    """``sums(*keys, w0, w1, u, a, b)``, a row for each cluster -> ``(*keys, r, u, a, b)``, a row for each replicate and batch of clusters."""
    fields = [*(sums.schema[k] for k in keys), *(T.StructField(c, T.LongType()) for c in ("r", "u", "a", "b"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in keys), strict=True) if keys else [()] * batch.num_rows):
                members.setdefault(key, []).append(k)
            w0, w1, *counts = (batch.column(c).to_numpy() for c in ("w0", "w1", "u", "a", "b"))
            counts = np.stack(counts)
            for rows in members.values():
                total = np.zeros((3, replicates), np.int64)
                for at in range(0, len(rows), block):
                    part = np.array(rows[at : at + block])
                    total += counts[:, part] @ multiplicities(w0[part], w1[part], replicates, seed)
                own = [batch.column(c).take(pa.array([rows[0]] * replicates)) for c in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(replicates)), *map(pa.array, total)], names=[f.name for f in fields])

    return sums.select(*keys, "w0", "w1", "u", "a", "b").mapInArrow(run, T.StructType(fields))


def bootstrap_interval(counts: DataFrame, cluster: Column, units: str, errors: str, others: str, *keys: str, replicates: int = 5000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """``(*keys, clusters, units, rate, other_rate, difference, low, high)``: a paired percentile interval of the difference of two corpus error rates.

    ``counts`` has the units of each row and the errors of two systems on it.
    Rows of a cluster are drawn together: their counts are summed once, and
    each replicate multiplies the sums, which add up in the tasks, so that the
    exchange has a row for each replicate and batch of clusters.  A replicate without units counts for nothing.
    """
    sums = counts.groupBy(*keys, cluster.alias("cluster")).agg(*(F.first(w).alias(f"w{k}") for k, w in enumerate(cluster_words(cluster))), F.sum(units).cast("long").alias("u"), F.sum(errors).cast("long").alias("a"), F.sum(others).cast("long").alias("b"))
    sums = Scratch(counts.sparkSession, "bootstrap").save(sums)
    drawn = replicate_sums(sums, list(keys), replicates, seed).groupBy(*keys, "r").agg(*(F.sum(c).alias(c) for c in ("u", "a", "b")))
    # one number for each replicate, however many clusters there are
    tails = F.percentile((F.col("a") - F.col("b")) / F.nullif(F.col("u"), F.lit(0)), F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    found = drawn.groupBy(*keys).agg(tails.alias("q"))
    whole = sums.groupBy(*keys).agg(F.count("*").alias("clusters"), F.sum("u").alias("units"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    joined = whole.join(F.broadcast(found)) if not keys else whole.alias("l").join(found.alias("r"), _all([F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])).select("l.*", "q")
    rate = lambda x: F.round(x / F.nullif(F.col("units"), F.lit(0)), 9)
    return joined.select(*keys, "clusters", "units", rate(F.col("a")).alias("rate"), rate(F.col("b")).alias("other_rate"), rate(F.col("a") - F.col("b")).alias("difference"), *(F.round(F.get("q", F.lit(k)), 9).alias(n) for k, n in enumerate(("low", "high"))))


def share_of_batch(df: DataFrame, batch: str, weight: str, seconds: str) -> DataFrame:
    """``df`` with ``share``: a batch's seconds dealt out by weight."""
    return df.withColumn("share", F.col(seconds) * F.col(weight) / F.sum(weight).over(Window.partitionBy(batch)))


def edit_counts(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of a least-cost alignment; on a tie an insertion, then a deletion, then a substitution."""
    row = [(j, 0, 0, j) for j in range(len(hypothesis) + 1)]
    for i, r in enumerate(reference, 1):
        after = [(i, 0, i, 0)]
        for j, h in enumerate(hypothesis, 1):
            c, s, d, n = row[j - 1]
            same = (c, s, d, n) if r == h else (c + 1, s + 1, d, n)
            up, left = row[j], after[j - 1]
            after.append(min((left[0] + 1, left[1], left[2], left[3] + 1), (up[0] + 1, up[1], up[2] + 1, up[3]), same, key=lambda x: x[0]))
        row = after
    return row[-1][1:]


def edit_counts_of(pairs: list[tuple[list[str], list[str]]], cells: int = 1 << 22) -> np.ndarray:
    """:func:`edit_counts` of each pair, for groups of pairs of about one size at once; a group's tables have at most ``cells`` cells, or are of one pair."""
    out = np.zeros((len(pairs), 3), np.int64)
    sizes = [(len(r), len(h)) for r, h in pairs]
    group: list[int] = []
    n = m = 0
    for k in sorted(range(len(pairs)), key=lambda k: (sizes[k][0] // 8, sizes[k][1])):
        n, m = max(n, sizes[k][0]), max(m, sizes[k][1])
        if group and (len(group) + 1) * (n + 1) * (m + 1) > cells:
            out[group] = _edit_group([pairs[g] for g in group])
            group, (n, m) = [], sizes[k]
        group.append(k)
    if group:
        out[group] = _edit_group([pairs[g] for g in group])
    return out


def _edit_group(pairs: list[tuple[list[str], list[str]]]) -> np.ndarray:
    """(substitutions, deletions, insertions) of each pair: all tables row by row, each cell with the deletions on its path.

    Two rows are held at a time.  A cell's cost, its deletions and its place
    give the other counts: insertions exceed deletions by as much as the
    hypothesis exceeds the reference.
    """
    names: dict[str, int] = {}
    count = len(pairs)
    i, j = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    ref, hyp = np.full((count, i.max()), -1, np.int32), np.full((count, j.max()), -2, np.int32)
    for k, (r, h) in enumerate(pairs):
        ref[k, : len(r)] = [names.setdefault(w, len(names)) for w in r]
        hyp[k, : len(h)] = [names.setdefault(w, len(names)) for w in h]
    steps = np.arange(hyp.shape[1] + 1, dtype=np.int32)
    row, gone = np.tile(steps, (count, 1)), np.zeros((count, len(steps)), np.int32)
    cost, deletions = j.copy(), np.zeros(count, np.int64)
    for at in range(1, ref.shape[1] + 1):
        after = np.full_like(row, at)
        np.minimum(row[:, :-1] + (ref[:, at - 1, None] != hyp), row[:, 1:] + 1, out=after[:, 1:])
        after = np.minimum.accumulate(after - steps, axis=1) + steps
        # on a tie an insertion, then a deletion, else the words are the same or one stands for the other
        own = gone + 1
        own[:, 1:] = np.where(row[:, 1:] < after[:, 1:], gone[:, 1:] + 1, gone[:, :-1])
        inserted = np.zeros_like(row)
        inserted[:, 1:] = np.where(after[:, :-1] < after[:, 1:], 0, steps[1:])
        # insertions keep the deletions of the cell that they start from
        gone = np.take_along_axis(own, np.maximum.accumulate(inserted, axis=1), axis=1)
        row = after
        done = np.flatnonzero(i == at)
        cost[done], deletions[done] = row[done, j[done]], gone[done, j[done]]
    insertions = deletions + j - i
    return np.stack([cost - deletions - insertions, deletions, insertions], axis=1)


#: Characters of the pairs whose words are held at once.
HELD_CHARS = 1 << 19


def counted(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Units and errors of each pair of texts, null as empty; pairs of about one length are split into words together, some at a time."""
    chars = [(len(r or ""), len(h or "")) for r, h in zip(ref, hyp, strict=True)]
    out = np.zeros((len(chars), 4), np.int64)

    def count(part: list[int]) -> None:
        words = [((ref.iloc[k] or "").split(), (hyp.iloc[k] or "").split()) for k in part]
        out[part, 0] = [len(r) for r, _ in words]
        out[part, 1:] = edit_counts_of(words)

    part: list[int] = []
    held = 0
    for k in sorted(range(len(chars)), key=lambda k: (chars[k][0] // 64, chars[k][1])):
        if part and held + sum(chars[k]) > HELD_CHARS:
            count(part)
            part, held = [], 0
        part.append(k)
        held += sum(chars[k])
    if part:
        count(part)
    return pd.DataFrame(out, columns=["units", "substitutions", "deletions", "insertions"])


def word_errors(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """``pairs`` with ``units, substitutions, deletions, insertions``, over words."""

    @F.pandas_udf("units long, substitutions long, deletions long, insertions long")
    def count(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
        return counted(ref, hyp)

    return pairs.withColumn("_c", count(reference, hypothesis)).select(*pairs.columns, "_c.*")


def batch_rollup(batches: DataFrame, *keys: str) -> DataFrame:
    """Totals over batch history rows ``(rows, frames, padded, tokens, failed)``: sums, the largest and the least non-zero batch, failed ones apart."""
    good = F.when(~F.col("failed"), F.col("rows"))
    total = lambda c: F.coalesce(F.sum(F.when(~F.col("failed"), F.col(c))), F.lit(0)).alias(c)
    return batches.groupBy(*keys).agg(F.count(good).alias("batches"), F.count_if("failed").alias("memory_failures"), *map(total, ("rows", "frames", "padded", "tokens")), F.max(good).alias("largest"), F.min(F.nullif(good, F.lit(0))).alias("least"))
