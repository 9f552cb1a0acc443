"""Merkle manifest of a table: a digest of each row, of each group of rows and of all, with a proof for each row.

Rows are leaves.  A group's leaves stand in order; while several nodes remain,
every ``fanout`` consecutive ones, and the rest of them, become one.  The
groups' roots are then the leaves of a last tree, in order of the groups.

Leaves get their place in their group from a range-partitioned sort: the place
within the task, plus the counts of earlier tasks.  Blocks aligned to a power
of the fanout hold whole subtrees, so that one task walks a block in postorder:
each call returns its subtree's digest, and while the recursion unwinds the
siblings met are appended to the leaves below them.  The blocks' roots are
nodes of the next distributed traversal, until each group has one node.  No
task ever holds more than one block, however large a group.

Defined results: null fields are told apart from empty ones; a null group and
a null id come first; rows with equal ids stand in order of their digests, so
equal rows are equal leaves with a place each; an empty table has no rows and
no root.  Texts are hashed whole.  Columns of other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import Scratch

#: Rows of a table of offsets or upper paths that may be sent to every task.
SMALL = 20_000


def field(value: Column) -> Column:
    """A value as the leaf's digest reads it: ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """The digest of a row, in hex."""
    return F.sha2(F.concat(*map(field, values)), 256)


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level and left to right."""
    return F.sha2(F.concat(F.lit(""), F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, digest, lambda own, s: F.sha2(F.concat(s["l"], own, s["r"]), 256))


def small(df: DataFrame) -> DataFrame:
    """``df`` sent to every task if it has few rows; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def numbered(nodes: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``nodes(g, ...)`` with ``rank``, the place among the nodes of ``g`` in the given order, and ``n``, their number.

    The last sort key tells equal rows apart, so that a range of them can be split.
    """
    once = scratch.save(nodes.withColumn("row", F.monotonically_increasing_id()))
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order, "row")]
    # in a sorted task the upper bits of the number are the task, the lower ones the place
    at = F.monotonically_increasing_id()
    placed = once.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", at).withColumn("part", F.shiftright("at", 33))
    placed = scratch.save(placed.drop("row"))
    scratch.drop(once)
    counts = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    every = Window.partitionBy("g")
    earlier = F.sum("rows").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")
    starts = scratch.save(counts.select("g", "part", (F.col("first") - earlier).alias("start"), F.sum("rows").over(every).alias("n")))
    return placed.join(small(starts), ["g", "part"]).withColumn("rank", F.col("at") - F.col("start")).drop("at", "part", "start")


class Subtree:
    """The postorder walk of one block of leaves."""

    def __init__(self, digests: list[str], fanout: int):
        self.digests, self.fanout = digests, fanout
        self.paths: list[list[dict[str, str]]] = [[] for _ in digests]

    def walk(self, first: int, end: int, height: int) -> str:
        """The digest over the leaves from ``first`` to ``end``; their paths get the siblings on the way back."""
        if not height:
            return self.digests[first]
        step = self.fanout ** (height - 1)
        starts = range(first, end, step)
        kids = [self.walk(a, min(a + step, end), height - 1) for a in starts]
        for k, a in enumerate(starts):
            siblings = {"l": "".join(kids[:k]), "r": "".join(kids[k + 1 :])}
            for path in self.paths[a : min(a + step, end)]:
                path.append(siblings)
        return hashlib.sha256("".join(kids).encode()).hexdigest()


def height_of(n: int, fanout: int) -> int:
    """Levels above ``n`` leaves."""
    height, reach = 0, 1
    while reach < n:
        height, reach = height + 1, reach * fanout
    return height


PATH = T.ArrayType(T.StructType([T.StructField("l", T.StringType()), T.StructField("r", T.StringType())]))


def traverse(nodes: DataFrame, fanout: int, levels: int, scratch: Scratch) -> DataFrame:
    """``nodes(g, rank, n, digest, own)`` -> ``(own, g, rank, block, blocks, path, top)``: one traversal of all blocks.

    ``own`` is any struct that stays with its node; ``path`` has the siblings
    up to the block's root ``top``, ``blocks`` is the number of the group's blocks.
    """
    size = fanout**levels
    member = F.struct("rank", "digest", "own").alias("m")
    blocks = nodes.groupBy("g", F.floor(F.col("rank") / size).alias("block"), "n").agg(F.sort_array(F.collect_list(member)).alias("m"))
    own = nodes.schema["own"].dataType
    schema = T.StructType(
        [T.StructField("own", own), T.StructField("g", T.StringType()), T.StructField("rank", T.LongType()), T.StructField("block", T.LongType()), T.StructField("blocks", T.LongType()), T.StructField("path", PATH), T.StructField("top", T.StringType())]
    )
    arrow_path = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a block a time, since a batch can hold many
            for k in range(batch.num_rows):
                g, block, n = (batch.column(c)[k].as_py() for c in ("g", "block", "n"))
                members = batch.column("m").slice(k, 1).flatten()
                tree, count = Subtree(members.field("digest").to_pylist(), fanout), -(-n // size)
                top = tree.walk(0, len(members), levels if count > 1 else height_of(n, fanout))
                whole = lambda v, kind, m=len(members): pa.array([v] * m, kind)
                columns = [members.field("own"), whole(g, pa.string()), members.field("rank"), whole(block, pa.int64()), whole(count, pa.int64()), pa.array(tree.paths, arrow_path), whole(top, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return scratch.save(blocks.mapInArrow(run, schema))


def trees(nodes: DataFrame, fanout: int, levels: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``nodes(g, rank, n, digest, own)`` -> ``(own, g, path)`` with the whole path to the group's root, and ``(g, digest)`` of the roots."""
    floors = [traverse(nodes, fanout, levels, scratch)]
    while floors[-1].filter("blocks > 1").limit(1).count():
        tops = floors[-1].groupBy("g", "block", "blocks").agg(F.first("top").alias("digest"))
        floors.append(traverse(tops.select("g", F.col("block").alias("rank"), F.col("blocks").alias("n"), "digest", F.struct(F.lit(0).alias("none")).alias("own")), fanout, levels, scratch))
    roots = floors[-1].groupBy("g").agg(F.first("top").alias("digest"))
    upper = floors.pop().select("own", "g", "rank", "path")
    while floors:
        above = upper.select("g", F.col("rank").alias("block"), F.col("path").alias("above"))
        upper = floors.pop().join(small(above), ["g", "block"]).select("own", "g", "rank", F.concat("path", "above").alias("path"))
    return upper.select("own", "g", "path"), roots


def prove(df: DataFrame, digest: Column, group_col: str = "source", id_col: str = "doc_id", *, carry: dict[str, Column] | None = None, fanout: int = 3, levels: int = 6) -> DataFrame:
    """``(id, group, leaf, path, subroot, root, ...)`` for each row of ``df``.

    ``digest`` is the row's leaf, as of :func:`leaf`; ``path`` is a list of
    ``(l, r)``, the siblings on either side at each level as joined hex, so
    that :func:`folded` of leaf and path is the root.  ``carry`` names further
    columns to be kept.
    """
    scratch = Scratch(df.sparkSession, "merkle")
    kept = {"id": F.col(id_col), "group": F.col(group_col), **(carry or {})}
    own = F.struct(*(v.alias(k) for k, v in kept.items()))
    # the first character sorts the null group before all others
    leaves = df.select(F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0")).alias("g"), F.col(id_col).alias("id"), digest.alias("digest"), own.alias("own"))
    placed, roots = trees(numbered(leaves, ["id", "digest"], scratch).select("g", "rank", "n", "digest", F.struct("digest", "own").alias("own")), fanout, levels, scratch)
    roots = scratch.save(roots)
    groups = numbered(roots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), ["name"], scratch)
    heads, root = trees(groups.select("g", "rank", "n", "digest", F.struct("name", "digest").alias("own")), fanout, levels, scratch)
    heads = heads.join(F.broadcast(root.select("g", F.col("digest").alias("root"))), "g")
    heads = scratch.save(heads.select(F.col("own.name").alias("g"), F.col("own.digest").alias("subroot"), F.col("path").alias("above"), "root"))
    rows = placed.join(small(heads), "g")
    return rows.select(*(F.col(f"own.own.{k}").alias(k) for k in kept), F.col("own.digest").alias("leaf"), F.concat("path", "above").alias("path"), "subroot", "root")


def manifest(proofs: DataFrame) -> DataFrame:
    """``(group, leaves, subroot, root)`` of the rows of :func:`prove`."""
    return proofs.groupBy("group", "subroot", "root").agg(F.count("*").alias("leaves"))
