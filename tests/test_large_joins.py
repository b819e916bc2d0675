"""Joins whose sides grow with the input are never broadcast by their compressed size."""

from pyspark.sql import functions as F

from quern.llm.simhash import links
from quern.operators import graph as go
from quern.plans.tables import written


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_broadcast_nothing(spark):
    nodes = written(spark.range(300).select(F.xxhash64("id").alias("fp")), "nodes")
    assert "BroadcastHashJoin" not in plan(links(nodes))


def test_one_label_for_most_nodes(spark):
    n = 3000
    star = spark.range(1, n).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    labels, run = go.propagated_components(star, spark.range(n + 5).select(F.col("id").alias("node")))
    assert run.converged
    assert sorted(map(tuple, labels.collect())) == [(i, 0 if i < n else i) for i in range(n + 5)]
