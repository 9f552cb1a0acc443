"""SimHash near-duplicates, searched with BK-trees.

A document's fingerprint has, for each bit, the majority over its word
shingles.  Fingerprints at most ``radius`` bits apart are linked.  The search
runs in *shards*: rows that share a shard key.  With :func:`band_keys` the
keys are the values of block combinations of the fingerprint, so that by the
pigeonhole principle any two fingerprints within the radius share a shard and
no link is lost; the more rows, the more and longer keys.  Each shard holds BK-trees of at most ``tree_nodes`` nodes on
average; a hot shard has several, and each tree is sent to every block of the
shard's members, which follow only the edges within the radius.  Inside such
a task links are united at once, and at most one row for each member leaves.

Defined results: null and blank texts have fingerprint zero, and zero
fingerprints link like any others; equal texts are linked whatever their
number; a null id stays, with the component of its fingerprint.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import Scratch
from .graph import components

#: Shingles whose bits are counted at once, which bounds the memory for a very long text.
BLOCK = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words; of the whole sequence if it is shorter."""
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    return np.fromiter((digest(s, seed) for s in map(b" ".join, zip(*(words[k:] for k in range(width))))), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have set."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[k : k + BLOCK])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text; zero without words."""
    return majority(shingle_hashes(words_of(text), width))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)``: each row's 64-bit SimHash as 8 big-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fingerprint(t, width).to_bytes(8, "big") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "fp"])

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("fp", T.BinaryType())])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def band_masks(bits: int, radius: int, blocks: int) -> list[int]:
    """A mask for each choice of ``blocks - radius`` of the fingerprint's blocks; two fingerprints within the radius agree under one of them."""
    if blocks <= radius:
        raise ValueError("blocks must exceed radius")
    cuts = [bits * k // blocks for k in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(one, blocks - radius)]


def enough_blocks(rows: int, radius: int, share: int = 32) -> int:
    """The fewest blocks whose shards have no more than about ``share`` unlike fingerprints, were those spread evenly."""
    return next((b for b in range(radius + 1, 64) if rows <= share << 64 * (b - radius) // b), 64)


def band_keys(items: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """``(fp, key)`` for 64-bit fingerprints: one shard key for each mask of :func:`band_masks`."""
    masks = band_masks(64, radius, blocks or radius + 1)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    value = F.conv(F.hex("fp"), 16, -10).cast("long")
    keys = F.array(*(F.struct(F.lit(k).alias("b"), value.bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(signed)))
    return items.select("fp", F.explode(keys).alias("key"))


class BKTree:
    """A Burkhard-Keller tree over integers: children keyed by their Hamming distance to the parent."""

    __slots__ = ("kids", "values")

    def __init__(self) -> None:
        self.values: list[int] = []
        self.kids: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        """Insert a value; one already present stays single."""
        at = 0
        if self.values:
            while True:
                d = (self.values[at] ^ value).bit_count()
                if not d:
                    return
                after = self.kids[at].get(d)
                if after is None:
                    self.kids[at][d] = len(self.values)
                    break
                at = after
        self.values.append(value)
        self.kids.append({})

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Every stored value at most ``radius`` bits away."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield self.values[at]
            kids = self.kids[at]
            if len(kids) <= 2 * radius + 1:
                todo += [k for e, k in kids.items() if d - radius <= e <= d + radius]
            else:
                todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]


def link_block(nodes: list[int], queries: list[int], radius: int, same: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """(member, root) for each member that a link joins to a smaller one, over the tree of ``nodes`` and the block ``queries``.

    With ``same``, two values within the radius are linked only if it says so;
    it is not asked about members that other links have joined.
    """
    tree = BKTree()
    for x in nodes:
        tree.add(x)
    root: dict[int, int] = {}
    planted = set(tree.values)  # least members of groups that hold a node of the tree
    groups = len(planted)

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for q in queries or nodes:
        for x in tree.within(q, radius):
            a, b = find(q), find(x)
            if a != b:
                if same and not same(q, x):
                    continue
                groups -= a in planted and b in planted
                if a in planted or b in planted:
                    planted.add(min(a, b))
                root[max(a, b)] = min(a, b)
            elif groups > 1:
                continue
            # once the tree's nodes are one group, any link to it says all
            if groups == 1 and x != q:
                break
    return [(x, find(x)) for x in root if find(x) != x]


def tree_rows(keyed: DataFrame, tree_nodes: int, scratch: Scratch) -> DataFrame:
    """``(key, fp, p(i, j, role))``: the places of each member of ``keyed(fp, key)`` in the blocks of its shard.

    Shards of one member have no blocks.  A member of a shard with n trees goes
    to n + 1 blocks, so a block never has more than about two trees' members.
    """
    # written before the join, so that Spark can split a hot shard
    size = scratch.save(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    trees = F.ceil(F.col("n") / F.lit(tree_nodes)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    placed = keyed.join(size, "key").withColumn("trees", trees).withColumn("own", own)
    # role 0: a node of tree i; role 1: a query of block j sent to tree i < j
    as_node = F.transform(F.sequence(F.col("own"), F.col("trees") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(0).alias("role")))
    as_query = F.when(F.col("own") > 0, F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(1).alias("role")))).otherwise(F.expr("array()"))
    return placed.select("key", "fp", F.explode(F.concat(as_node, as_query)).alias("p"))


def useful_blocks(keyed: DataFrame, tree_nodes: int, scratch: Scratch) -> DataFrame:
    """``(key, i, j, nodes, queries)`` of the blocks of ``keyed(fp, key)`` that can link anything."""
    blocks = tree_rows(keyed, tree_nodes, scratch).groupBy("key", F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(
        F.collect_list(F.when(F.col("p.role") == 0, F.col("fp"))).alias("nodes"), F.collect_list(F.when(F.col("p.role") == 1, F.col("fp"))).alias("queries")
    )

    # a diagonal block has its tree as queries; an off-diagonal one without queries (or nodes) links nothing
    return blocks.filter((F.col("i") == F.col("j")) & (F.size("nodes") > 1) | (F.size("nodes") > 0) & (F.size("queries") > 0))


def bk_links(keyed: DataFrame, radius: int, scratch: Scratch, tree_nodes: int = 2048) -> DataFrame:
    """``keyed(fp, key)`` of distinct pairs -> links ``(u, v)`` of fingerprints that join the same groups as all links within shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for nodes, queries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                width = len(nodes[0]) if nodes else 8
                for a, b in link_block([int.from_bytes(x, "big") for x in nodes], [int.from_bytes(x, "big") for x in queries], radius):
                    u.append(a.to_bytes(width, "big"))
                    v.append(b.to_bytes(width, "big"))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return useful_blocks(keyed, tree_nodes, scratch).select("nodes", "queries").mapInArrow(run, "u binary, v binary").distinct()


def near_members(keyed: DataFrame, radius: int, tree_nodes: int, scratch: Scratch) -> DataFrame:
    """The rows of ``keyed(fp, key)`` that have another member of their shard within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, fp = [], []
            for k, (nodes, queries) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                width = len(nodes[0])
                links = link_block([int.from_bytes(x, "big") for x in nodes], [int.from_bytes(x, "big") for x in queries], radius)
                # who is linked to anything is a member or a root
                some = {x for link in links for x in link}
                at += [k] * len(some)
                fp += [x.to_bytes(width, "big") for x in some]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(fp, pa.binary())], names=["key", "fp"])

    schema = T.StructType([T.StructField("key", keyed.schema["key"].dataType), T.StructField("fp", T.BinaryType())])
    return useful_blocks(keyed, tree_nodes, scratch).select("key", "nodes", "queries").mapInArrow(run, schema).distinct()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets of hashes; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int(np.count_nonzero(a[at] == b))
    return both / (len(a) + len(b) - both)


def confirmed_links(near: DataFrame, texts: DataFrame, radius: int, width: int, similarity: float, tree_nodes: int, scratch: Scratch) -> DataFrame:
    """``near(key, fp)`` and ``texts(fp, text)`` -> links ``(u, v)`` that join the same groups as all links within shards whose shingle sets are as similar as ``similarity``.

    The rows of a block come one after the other, so a task holds the shingle sets of one block.
    """

    def links(block: dict[bytes, np.ndarray], nodes: list[bytes], queries: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        sets = {int.from_bytes(x, "big"): h for x, h in block.items()}

        def same(x: int, y: int) -> bool:
            a, b = sets[x], sets[y]
            # sets of sizes too far apart are spared the comparison
            return min(len(a), len(b)) >= similarity * max(len(a), len(b)) - 1 and jaccard(a, b) >= similarity

        size = len(nodes[0]) if nodes else 0
        found = link_block([int.from_bytes(x, "big") for x in nodes], [int.from_bytes(x, "big") for x in queries], radius, same)
        return [a.to_bytes(size, "big") for a, _ in found], [b.to_bytes(size, "big") for _, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, members = None, {}, ([], [])
        # an off-diagonal block without queries would take its nodes as queries, which its diagonal block does
        whole = lambda: members[0] and (members[1] or now[1] == now[2])
        for batch in batches:
            u, v = [], []
            for b, value, i, j, role, fp, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != ((b, value), i, j):
                    if now and whole():
                        more = links(block, *members)
                        u += more[0]
                        v += more[1]
                    now, block, members = ((b, value), i, j), {}, ([], [])
                block[fp] = np.unique(shingle_hashes(words_of(text), width))
                members[role].append(fp)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])
        if now and whole():
            u, v = links(block, *members)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    place = ["b", "v", "i", "j"]
    rows = tree_rows(near, tree_nodes, scratch).select(F.col("key.b").alias("b"), F.col("key.v").alias("v"), "p.i", "p.j", "p.role", "fp").join(texts, "fp")
    return rows.select(*place, "role", "fp", "text").repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "u binary, v binary").distinct()


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, radius: int = 2, blocks: int | None = None, tree_nodes: int = 2048) -> DataFrame:
    """``(id_col, fingerprint, component_id)``: each row's fingerprint in hex and the least id in its linked group."""
    scratch = Scratch(df.sparkSession, "simhash")
    prints = scratch.save(fingerprints(df, id_col, text_col, width))
    blocks = blocks or enough_blocks(prints.count(), radius)
    groups = group_ids(prints, lambda items: band_keys(items, radius, blocks), radius, tree_nodes, scratch)
    return prints.join(groups, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def sketch(text: str | None, width: int, keys: int) -> tuple[bytes, list[int]]:
    """A 256-bit SimHash and ``keys`` shard keys of a text: each key joins the minima of two hash orders of its shingles.

    Two texts whose shingle sets have Jaccard similarity s share a key with
    probability s * s, and any of them with 1 - (1 - s * s) ** keys.
    """
    h = np.unique(shingle_hashes(words_of(text), width))
    if not len(h):
        return bytes(32), [0] * keys
    print_ = b"".join(majority(remix(h, k)).to_bytes(8, "big") for k in range(4))
    least = [int(remix(h, 4 + k).min()) for k in range(2 * keys)]
    return print_, [(a * 0x9E3779B97F4A7C15 + b) % (1 << 63) for a, b in zip(least[::2], least[1::2], strict=True)]


def remix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash function made from 64-bit hashes."""
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def similar_radius(similarity: float, deviations: float = 4) -> int:
    """Differing bits of 256 expected at a Jaccard similarity, and some standard deviations more.

    The share of bits is that of two large sets of one size, or the 3 of 16 at
    which the majorities of 4 and of 5 hashes differ if that is more: ties of
    small sets cost more bits, and no pair at 0.8 costs more than that one.
    """
    p = max(math.acos(2 * similarity / (1 + similarity)) / math.pi, 3 / 16)
    return round(256 * p + deviations * math.sqrt(256 * p * (1 - p)))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, similarity: float = 0.8, keys: int = 10, tree_nodes: int = 2048) -> DataFrame:
    """``(id_col, component_id)``: the least id in each row's group of texts, linked where the Jaccard similarity of their shingle sets is at least ``similarity``.

    Shards are by minima of shingle hashes, since a radius as wide as this
    similarity needs leaves no fingerprint block unchanged; within a shard the
    BK-trees follow the edges within the radius and leave candidates, whose
    links are confirmed by their shingle sets.  At the similarity itself a
    pair shares a shard with probability 1 - (1 - s * s) ** keys: 0.99996, and
    is within the radius with about as much.  Texts of one 256-bit fingerprint
    are taken as one.  Null and blank texts are copies of each other; a null
    id gets the least id of its group, rows that share an id each get their
    own group's; texts are read whole, and an empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "neardup")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(t, width, keys) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f for f, _ in made], pa.binary()), pa.array([k for _, k in made], pa.list_(pa.int64()))], names=["id", "fp", "keys"]).append_column("text", batch.column(1))

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("fp", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("text", T.StringType())])
    prints = scratch.save(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema))
    shards = scratch.save(prints.select("fp", F.posexplode("keys").alias("b", "v")).select("fp", F.struct("b", "v").alias("key")).distinct())
    radius = similar_radius(similarity)
    near = scratch.save(near_members(shards, radius, tree_nodes, scratch))
    texts = prints.groupBy("fp").agg(F.min("text").alias("text")).join(near.select("fp").distinct(), "fp", "left_semi")
    groups = joined_ids(prints, confirmed_links(near, texts, radius, width, similarity, tree_nodes, scratch), scratch)
    return prints.select("id", "fp").join(groups, "fp", "left").select(F.col("id").alias(id_col), "component_id")


def group_ids(prints: DataFrame, keys: Callable[[DataFrame], DataFrame], radius: int, tree_nodes: int, scratch: Scratch) -> DataFrame:
    """``(fp, component_id)`` for the distinct fingerprints of ``prints(id, fp, ...)``."""
    return joined_ids(prints, bk_links(scratch.save(keys(prints.select("fp").distinct()).distinct()), radius, scratch, tree_nodes), scratch)


def joined_ids(prints: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(fp, component_id)`` for the distinct fingerprints of ``prints(id, fp, ...)``, by the links ``pairs(u, v)``."""
    items = prints.groupBy("fp").agg(F.min("id").alias("least"))
    links = components(pairs, scratch)
    rooted = scratch.save(items.join(links.select(F.col("u").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = scratch.save(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return rooted.join(least, "root").select("fp", "component_id")
