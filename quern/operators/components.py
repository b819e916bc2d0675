"""Connected components by alternating large-star and small-star rounds.

Stars end as hubs, so a hub's rows never go to one task: nodes with more than a
thousandth of all rows (fewer than a thousand nodes) meet their minimum by a broadcast, all others by a
shuffle, and minima are pre-aggregated in every task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.tables import drop_written, split_join, written


def _minima(rows: DataFrame) -> DataFrame:
    return rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _large(e: DataFrame, total: int) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _minima(both).withColumn("m", F.least("m", "u"))
    return split_join(both, low, "u", "n", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame, total: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _minima(down)
    kept = split_join(down, low, "u", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(low.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", run=None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    Nodes without links do not appear. Self links, repeated links and either
    direction are fine; links with a null end are dropped. Each star step is written to
    the shared folder; the driver sees only a count and a checksum. ``run`` takes notes of the rounds.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    total = e.count()
    while True:
        large = written(_large(e, total).distinct(), "edges")
        drop_written(e)
        e = written(_small(large, total).where("u <> v").distinct(), "edges")
        drop_written(large)
        if run:
            run.iterations, run.edge_iterations, run.max_frontier = run.iterations + 1, run.edge_iterations + total, max(run.max_frontier, total)
        sign = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sign) == seen:
            break
        seen = tuple(sign)
        total = sign[0]
    if run:
        run.converged = True
    node = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return node.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
