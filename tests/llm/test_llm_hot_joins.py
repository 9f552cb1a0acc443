"""Joins back to hot keys are between written tables, so that Spark can split them."""

import pytest
from pyspark.sql import functions as F

from spanloom.llm import graph, simhash
from spanloom.sources.scratch import Scratch

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def small_limits(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_node_is_split(spark, small_limits):
    scratch = Scratch(spark, "hot")
    edges = scratch.save(spark.range(1, 60_000).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v")).repartition(16))
    assert "skew=true" in plan_of(graph._star(edges, False, scratch))
    roots = graph.components(edges, scratch)
    assert roots.count() == 59_999 and roots.agg(F.max("root")).first()[0] == 0


def test_a_hot_shard_is_split(spark, small_limits):
    scratch = Scratch(spark, "hot")
    keyed = scratch.save(spark.range(60_000).select(F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("fp"), F.when(F.col("id") % 20 > 0, 0).otherwise(F.col("id")).alias("key")).repartition(16))
    assert "skew=true" in plan_of(simhash.tree_rows(keyed, 2048, scratch))

