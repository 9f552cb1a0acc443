"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def _star(edges: DataFrame, small: bool, scratch: Scratch) -> DataFrame:
    """One round: every node hands its larger (or, if small, all its lower) neighbours the least node it knows.

    The least nodes are written before the join, so that Spark can split a hot node's arcs.
    """
    if small:
        arcs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.save(arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    moved = arcs.join(least, "u")
    if small:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u != v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(u, v)`` -> ``(u, root)`` for every node in an edge but the roots; root is the least node of its component.

    Nodes may be of any ordered type.  Each round is written to the scratch
    folder; only a row count and a checksum come to the driver.
    """
    now = scratch.save(edges.select("u", "v").filter("u != v").distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(seen) == mark or seen.n == 0:
            return now.select("u", F.col("v").alias("root"))
        mark = tuple(seen)
        large = scratch.save(_star(now, False, scratch))
        after = scratch.save(_star(large, True, scratch))
        scratch.drop(large)
        scratch.drop(now)
        now = after
