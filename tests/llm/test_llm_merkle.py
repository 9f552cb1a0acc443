"""The Merkle manifest against a plain recursion over lists."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from spanloom.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The root of a list and the siblings of each member, as (left, right) lists."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            run = at[k] // 3 * 3
            path.append((nodes[run : at[k]], nodes[at[k] + 1 : run + 3]))
            at[k] //= 3
        nodes = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> the query's rows, in any order."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = climb([plain_leaf(r) for r in groups[s]])
    if not names:
        return []
    root, above = climb([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        for r, path in zip(groups[s], trees[s][1], strict=True):
            told = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            own = plain_leaf((*r[:4], r[4] and r[4].replace("\n", ""))) if told else plain_leaf(r)
            for left, right in path + up:
                own = h(*left, own, *right)
            out.append((r[0], plain_leaf(r), trees[s][0], root, h(*(x for a, b in path + up for x in (*a, *b))), own, own == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.fixture
def proved(spark, tmp_path):
    def run(rows, levels=None):
        spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        prove = merkle.prove
        if levels:
            queries.merkle.prove = lambda *a, **b: prove(*a, **b, levels=levels)
        try:
            return sorted((tuple(r[c] for c in COLUMNS) for r in queries.op12_merkle(spark, str(tmp_path)).collect()), key=repr)
        finally:
            queries.merkle.prove = prove

    return run


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = [tuple(r[c] for c in COLUMNS) for r in queries.op12_merkle(spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)
    told = {i for i, *_, text in rows if zlib.crc32(str(i).encode()) % 2 == 0 and "\n" in text}
    assert told and {g[0] for g in got if not g[-1]} == told


@pytest.mark.parametrize("n", [0, 1, 4, 28])
def test_sizes_and_blocks(proved, n):
    """Several traversals of small blocks; a hot source, many single ones, and last runs of one node."""
    rng = random.Random(n)
    rows = [(k, rng.choice(["hot", "hot", "b", None, f"s{k}"]), "xx", k, "a\nb") for k in range(n)]
    want = sorted(plain(rows), key=repr)
    assert proved(rows, levels=1 + n % 2) == want


def test_odd_rows(proved):
    """Nulls in any column, empty and long texts, equal ids and equal rows, bytes of several widths."""
    rows = [(None, None, None, None, None), (None, "", "", 0, ""), (1, "é", "日本", -5, "x\n" * 40_000), (1, "é", "日本", -5, "x\n" * 40_000), (1, "é", None, None, "other"), (2, "é", "-", 1, "\n"), (None, None, None, None, None), (2, "z", "a:b", 3, "1:1"), (2, "Z", None, 3, None)]
    assert proved(rows, levels=1) == sorted(plain(rows), key=repr)


def test_general_interface(spark):
    """Any columns and any fanout; clashing names stay out of the way; folding a leaf gives the root, another digest doesn't."""
    df = spark.createDataFrame([(k, k % 3, f"v{k}", "g", 0, "p") for k in range(40)], "key int, grp int, v string, g string, rank int, path string")
    got = merkle.prove(df, merkle.leaf([F.col("key"), F.col("v")]), "grp", "key", carry={"g": F.col("g"), "rank": F.col("rank")}, fanout=2, levels=2)
    rows = got.withColumn("fine", merkle.folded(F.col("leaf"), F.col("path"))).withColumn("bad", merkle.folded(F.lit("0" * 64), F.col("path"))).collect()
    assert len(rows) == 40 and all(r.fine == r.root != r.bad and (r.g, r.rank) == ("g", 0) and r.leaf == plain_leaf((r.id, f"v{r.id}")) for r in rows)
    assert {tuple(r) for r in merkle.manifest(got).select("group", "leaves").collect()} == {(0, 14), (1, 13), (2, 13)}
