"""MinHash near-duplicates by an inverted join on signature coordinates.

A text's signature has ``width`` minimum hashes of its set of word shingles.
Each coordinate and its value are a key under which the text is posted.  Two
texts as similar as asked share at least ``least_matches`` keys, but for one
pair in a million at that very similarity.

*Prefix merging*: keys that only one text has collide with nothing, and a text
with too few other keys has no partner.  The keys of the rest are ordered from
rare to common; two texts with enough common keys share one among the first
``keys - least + 1`` of either, so only those are posted.  Passages that many
unlike texts share are common keys, which a prefix leaves out.  Postings with
equal members are merged into one.

*Skip merging*: within a posting, a text's collisions are counted over its
shortest inverted lists first; longer ones are only searched for the texts that
can still reach the threshold.

Candidates are confirmed on whole shingle sets.  A posting's candidates are
given as a forest, so that a group of n near copies gives n - 1 pairs and not
all of them.  Where a candidate group holds together without some pair of that
forest, it is done; where it falls apart, its parts are compared with each
other, blocks of sets a task, until no candidate pair between parts is left
unconfirmed.  So no link among the candidates is lost.

Defined results: texts with equal sets are one class from the start, whatever
their number; null and blank texts have no shingles, no links and their own id
as component; null ids take the least id of their group and are kept only if
it has none; equal ids in one group are kept together; an empty table gives no
rows.  Texts are read whole.  Columns of other names are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import Scratch
from .graph import components
from .simhash import shingle_hashes, words_of

#: Low bits of a key that hold its coordinate.
COORDINATE_BITS = 7
#: Shingles whose products are taken at once.
BLOCK = 256


def least_matches(width: int, percent: int, miss: float = 1e-6) -> int:
    """The largest number of equal coordinates that two sets of a Jaccard similarity of ``percent`` in 100 fall below with a probability of ``miss`` at most."""
    p, below, m = percent / 100, 0.0, 0
    while m < width:
        below += math.comb(width, m) * p**m * (1 - p) ** (width - m)
        if below > miss:
            break
        m += 1
    return max(1, m)


def multipliers(width: int) -> np.ndarray:
    """An odd factor for each coordinate, the same in every run."""
    return np.random.default_rng(11).integers(0, 1 << 63, width, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The keys of a set of 64-bit hashes: each coordinate's minimum product, with the coordinate in its low bits."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[k : k + BLOCK, None] * factors).min(0), out=least)
    low = np.uint64((1 << COORDINATE_BITS) - 1)
    return ((least & ~low) | np.arange(len(factors), dtype=np.uint64)).view(np.int64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted XXH64 of a text's distinct shingles."""
    return np.unique(shingle_hashes(words_of(text), words))


def set_digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def prints(df: DataFrame, id_col: str, text_col: str, words: int, width: int) -> DataFrame:
    """``(id, n, digest, keys)``: the size of each row's set, the set's digest and its signature; no keys for an empty set."""
    factors = multipliers(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, keys = [], [], []
            for text in batch.column(1):
                h = shingle_set(text.as_py(), words)
                n.append(len(h))
                digest.append(set_digest(h))
                keys.append(signature(h, factors) if len(h) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "digest", "keys"])

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def partnered(classes: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """``classes(cls, n, keys)`` -> ``(cls, n, keys)`` of those with ``least`` keys or more that others have too; only such keys, from rare to common."""
    postings = classes.select("cls", "n", F.explode("keys").alias("key"))
    counts = scratch.save(postings.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1"))
    own = F.sort_array(F.collect_list(F.struct("often", "key")))
    found = postings.join(counts, "key").groupBy("cls", "n").agg(own.alias("own")).filter(F.size("own") >= least)
    return scratch.save(found.select("cls", "n", F.col("own.key").alias("keys")))


def prefix_postings(texts: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """``(key, cls, members)``: the prefixes' postings of two texts or more, one for each set of members."""
    prefix = F.slice("keys", F.lit(1), F.size("keys") - F.lit(least - 1))
    posted = scratch.save(texts.select("cls", F.explode(prefix).alias("key")))
    # two sums over the members stand for the set
    who = [F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("y")]
    sets = posted.groupBy("key").agg(F.count("*").alias("members"), *who).filter("members > 1").groupBy("members", "x", "y").agg(F.min("key").alias("key"))
    return posted.join(scratch.save(sets.select("key", "members")), "key")


def blocks(rows: DataFrame, key: str, members: str, size: int) -> DataFrame:
    """``rows`` with their places ``(i, j, query)`` in the blocks of their group of ``members`` rows.

    A group of n trees of about ``size`` rows has a block for each pair of
    trees; a row goes to n of them, so no task holds more than two trees.
    """
    trees = F.ceil(F.col(members) / F.lit(size)).cast("int")
    own = F.pmod(F.xxhash64("cls"), trees).cast("int")
    as_node = F.transform(F.sequence(own, trees - 1), lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(False).alias("query")))
    as_query = F.when(own > 0, F.transform(F.sequence(F.lit(0), own - 1), lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(True).alias("query")))).otherwise(F.expr("array()"))
    return rows.withColumn("p", F.explode(F.concat(as_node, as_query))).select(F.col(key).alias("group"), "p.*", *(c for c in rows.columns if c not in (key, members)))


class Lists:
    """The inverted lists of a block's nodes by key."""

    def __init__(self, keys: list[np.ndarray]):
        flat = np.concatenate(keys)
        places = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(flat, kind="stable")
        flat, self.places = flat[order], places[order]
        self.keys, self.starts = np.unique(flat, return_index=True)
        self.ends = np.append(self.starts[1:], len(flat))

    def collisions(self, keys: np.ndarray, least: int) -> np.ndarray:
        """The nodes that share at least ``least`` of the keys, in order."""
        at = np.searchsorted(self.keys, keys)
        at = at[at < len(self.keys)] if at.max(initial=0) < len(self.keys) else np.minimum(at, len(self.keys) - 1)
        at = np.unique(at)
        at = at[np.isin(self.keys[at], keys)]
        at = at[np.argsort(self.ends[at] - self.starts[at], kind="stable")]
        lists = [self.places[a:b] for a, b in zip(self.starts[at], self.ends[at], strict=True)]
        short = len(lists) - least + 1
        if short < 1:
            return np.zeros(0, np.int64)
        found, count = np.unique(np.concatenate(lists[:short]), return_counts=True)
        for left, longer in zip(range(least - 1, 0, -1), lists[short:], strict=True):
            able = count + left >= least
            found, count = found[able], count[able]
            if not len(found):
                break
            place = np.minimum(np.searchsorted(longer, found), len(longer) - 1)
            count = count + (longer[place] == found)
        return found[count >= least]


class Forest:
    """Union-find over any labels, with the least one as root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(up, up)
            x = up
        return x

    def unite(self, x: int, y: int) -> bool:
        """False if they are one group already."""
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


class Member:
    """A row of a block."""

    __slots__ = ("cls", "hashes", "keys", "n", "part")

    def __init__(self, cls: int, n: int, keys: list[int], part: int | None, hashes: np.ndarray | None):
        self.cls, self.n, self.keys, self.part, self.hashes = cls, n, np.array(keys, np.int64), cls if part is None else part, hashes


def similar(inner: int, a: int, b: int, percent: int) -> bool:
    return 100 * inner >= percent * (a + b - inner)


def block_links(nodes: list[Member], queries: list[Member], least: int, percent: int) -> list[tuple[int, int]]:
    """Pairs of the block's candidates, or of its confirmed ones if it has sets, that unite what wasn't one part yet.

    Without queries, the nodes are compared with each other.
    """
    nodes.sort(key=lambda m: m.cls)
    lists, forest, out = Lists([m.keys for m in nodes]), Forest(), []
    for place, q in enumerate(queries or nodes):
        found = lists.collisions(q.keys, least)
        for k in found if queries else found[: np.searchsorted(found, place)]:
            x = nodes[k]
            if not similar(min(q.n, x.n), q.n, x.n, percent) or forest.find(q.part) == forest.find(x.part):
                continue
            if q.hashes is not None and not similar(len(np.intersect1d(q.hashes, x.hashes, assume_unique=True)), q.n, x.n, percent):
                continue
            forest.unite(q.part, x.part)
            out.append((q.cls, x.cls))
    return out


def linked(placed: DataFrame, least: int, percent: int) -> DataFrame:
    """``placed(group, i, j, query, cls, n, keys[, part, hashes])`` -> distinct ``(u, v)`` of :func:`block_links`, a block after the other."""
    place = ["group", "i", "j"]
    columns = [*place, "query", "cls", "n", "keys", *(["part", "hashes"] if "hashes" in placed.columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, queries = None, [], []

        def found() -> list[tuple[int, int]]:
            # a block of two trees without nodes or queries has nothing to compare
            return block_links(nodes, queries, least, percent) if nodes and (queries or now[1] == now[2]) else []

        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([max(p) for p in pairs], pa.int64()), pa.array([min(p) for p in pairs], pa.int64())], names=["u", "v"])

        for batch in batches:
            pairs = []
            for k in range(batch.num_rows):
                group, i, j, query, cls, n, keys, *more = (c[k].as_py() if name != "hashes" else c[k].values.to_numpy() for name, c in zip(columns, batch.columns, strict=True))
                if now != (group, i, j):
                    pairs += found() if now else []
                    now, nodes, queries = (group, i, j), [], []
                (queries if query else nodes).append(Member(cls, n, keys, *(more or (None, None))))
            yield out(pairs)
        if now:
            yield out(found())

    return placed.select(*columns).repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "u long, v long").distinct()


def sets_of(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``wanted(cls, digest, least)`` -> ``(cls, n, hashes)``: whole shingle sets, from the rows of ``df`` that have the class's least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                sets = [shingle_set(t.as_py(), words) for t in batch.column(0).slice(k, 200)]
                yield pa.RecordBatch.from_arrays([pa.array([set_digest(h) for h in sets], pa.binary()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["digest", "hashes"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ids = wanted.select("least").distinct()
    texts = rows.join(ids, F.col("id").eqNullSafe(F.col("least")), "left_semi").select("text")
    made = texts.mapInArrow(run, "digest binary, hashes array<bigint>").groupBy("digest").agg(F.first("hashes").alias("hashes"))
    return wanted.select("cls", "digest").join(made, "digest").select("cls", F.size("hashes").cast("long").alias("n"), "hashes")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` whose whole sets are similar enough."""
    u, v = (sets.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("hashes").alias(f"h_{c}")) for c in "uv")
    inner = F.size(F.array_intersect("h_u", "h_v"))
    return pairs.join(u, "u").join(v, "v").filter(100 * inner >= percent * (F.col("n_u") + F.col("n_v") - inner)).select("u", "v")


def minhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, percent: int = 85, width: int = 64, tree: int = 1024, set_tree: int = 256) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)`` for each row.

    Texts are linked where 100 times the size of their sets' intersection is
    at least ``percent`` times that of the union; ``component_id`` is the least
    id reachable by links.  ``tree`` and ``set_tree`` are the rows of a block
    in the search and in the comparison of sets.
    """
    scratch, least = Scratch(df.sparkSession, "minhash"), least_matches(width, percent)
    rows = scratch.save(prints(df, id_col, text_col, words, width))
    classes = rows.filter("n > 0").groupBy("digest").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = scratch.save(classes.withColumn("cls", F.monotonically_increasing_id()))
    texts = partnered(classes, least, scratch)
    postings = prefix_postings(texts, least, scratch)
    pairs = scratch.save(linked(blocks(postings.join(texts, "cls"), "key", "members", tree), least, percent))
    ends = pairs.select(F.explode(F.array("u", "v")).alias("cls")).distinct()
    sets = scratch.save(sets_of(df, classes.select("cls", "digest", "least").join(ends, "cls", "left_semi"), id_col, text_col, words))
    links = scratch.save(confirmed(pairs, sets, percent))

    # a group of candidates in several parts may have links that its forest left out
    group, part = components(pairs, scratch), components(links, scratch)
    named = sets.select("cls").join(group.select(F.col("u").alias("cls"), F.col("root").alias("group")), "cls", "left").join(part.select(F.col("u").alias("cls"), F.col("root").alias("part")), "cls", "left")
    named = scratch.save(named.select("cls", F.coalesce("group", "cls").alias("group"), F.coalesce("part", "cls").alias("part")))
    apart = scratch.save(named.groupBy("group").agg(F.count("*").alias("members"), F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b").select("group", "members"))
    split = named.join(apart, "group").join(texts.select("cls", "keys"), "cls").join(sets, "cls")
    more = linked(blocks(split, "group", "members", set_tree), least, percent)

    root = components(links.unionByName(more), scratch).select(F.col("u").alias("cls"), "root")
    joined = scratch.save(classes.select("cls", "digest", "least").join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    lowest = scratch.save(joined.groupBy("root").agg(F.min("least").alias("component_id")))
    found = scratch.save(joined.join(lowest, "root").select("digest", "component_id"))
    out = rows.select("id", "n", "digest").join(found, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
