"""MinHash near-duplicates against all pairs of whole shingle sets."""

import random
import re

import numpy as np
import pytest

from spanloom.llm import minhash, queries


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain(rows, percent=85):
    """(id, text) -> sorted (id, size, component, kept), by comparing all pairs of distinct sets."""
    sets = [shingles(t) for _, t in rows]
    known = list({s for s in sets if s})
    up = list(range(len(known)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(known)):
        for b in range(a):
            both = len(known[a] & known[b])
            if 100 * both >= percent * (len(known[a]) + len(known[b]) - both):
                up[find(a)] = find(b)
    at = {s: k for k, s in enumerate(known)}
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            r = find(at[s])
            least[r] = min(least.get(r, i), i)
    out = []
    for (i, _), s in zip(rows, sets, strict=True):
        c = least.get(find(at[s])) if s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in df.collect()), key=repr)


def test_whole_table(spark, sf, docs):
    want = plain(docs)
    assert sum(not r[3] for r in want) >= 10
    assert rows_of(queries.op11_minhash(spark, sf)) == want


def test_odd_rows(spark, odd):
    assert rows_of(minhash.minhash_components(odd)) == plain([(r.doc_id, r.text) for r in odd.collect()])


def test_empty_table(spark):
    assert minhash.minhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.fixture(scope="module")
def edited():
    """A hot group of near copies around the similarity, a passage that unlike texts share, exact copies, short texts and ids that repeat."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    base, passage, rows = [word() for _ in range(120)], [word() for _ in range(60)], []
    for k in range(150):
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            text[rng.randrange(len(text))] = word()
        rows.append((k, " ".join(text)))
    rows += [(200 + k, " ".join([*(word() for _ in range(150)), *passage])) for k in range(60)]
    rows += [(300 + k, "the very same few words here again and again") for k in range(30)] + [(330 + k, f"short text {k % 3}") for k in range(9)]
    # chains: each like the next, the ends unlike
    text = [word() for _ in range(90)]
    for k in range(20):
        rows.append((1000 - k, " ".join(text)))
        text[(7 * k) % 90] = word()
    return [*rows, (5, rows[8][1]), (None, rows[9][1]), (None, None), (None, "alone without an id")]


@pytest.mark.parametrize("tree", [4, 1024])
def test_hot_groups(spark, edited, tree):
    """Blocks of a few rows and of many give what all pairs give."""
    df = spark.createDataFrame(edited, "doc_id long, text string")
    want = plain(edited)
    assert len({r[2] for r in want}) > 60 and 100 < sum(not r[3] for r in want)
    assert rows_of(minhash.minhash_components(df, tree=tree, set_tree=tree)) == want


def test_parts_of_a_candidate_group_are_compared(spark, edited):
    """With a threshold far under the similarity, whole groups are candidates and only sets tell them apart."""
    made, df = minhash.least_matches, spark.createDataFrame(edited, "doc_id long, text string")
    minhash.least_matches = lambda width, percent: 8
    try:
        assert rows_of(minhash.minhash_components(df, set_tree=16)) == plain(edited)
        assert rows_of(minhash.minhash_components(df, percent=60)) == plain(edited, 60)
    finally:
        minhash.least_matches = made


def test_collisions_equal_plain_counts():
    rng = np.random.default_rng(1)
    for _ in range(300):
        nodes = [rng.choice(40, rng.integers(1, 20), replace=False) for _ in range(rng.integers(1, 30))]
        lists, query, least = minhash.Lists(nodes), rng.choice(60, rng.integers(1, 25), replace=False), int(rng.integers(1, 8))
        assert lists.collisions(query, least).tolist() == [k for k, n in enumerate(nodes) if len(set(n) & set(query)) >= least]


def test_signatures_collide_as_often_as_sets_are_alike():
    rng, factors = np.random.default_rng(2), minhash.multipliers(64)
    for like in (0.5, 0.85):
        seen = []
        for _ in range(300):
            n = int(rng.integers(40, 900))
            h = rng.integers(0, 1 << 63, 2 * n, np.uint64)
            k = round(n * (1 - like) / (1 + like))
            a, b = h[:n], h[k : n + k]
            exact = (n - k) / (n + k)
            seen.append(np.count_nonzero(minhash.signature(a, factors) == minhash.signature(b, factors)) / 64 - exact)
        assert abs(np.mean(seen)) < 0.01 and np.std(seen) < 1.15 * (like * (1 - like) / 64) ** 0.5


def test_threshold():
    """What is missed at the very similarity is one pair in a million, and one more match would miss more."""
    import math

    for width, percent in ((64, 85), (32, 80), (1, 85)):
        m = minhash.least_matches(width, percent)
        below = lambda m, p=percent / 100, w=width: sum(math.comb(w, k) * p**k * (1 - p) ** (w - k) for k in range(m))
        assert m == 1 or below(m) <= 1e-6 < below(m + 1)
