"""Graph operators over edges (src, dst[, weight]): traversal, components, shortest paths, statistics, compressed rows.

Traversal and paths settle blocks of compressed rows (``blocks``), whatever the depth. The other iterations are rounds of joins: what a round changes is appended to a table in the shared folder, which cuts lineage and survives lost
executors, and the next round reads the table as one scan; the driver only learns counts. Rounds have no limit but the one that a caller sets; each makes
progress. Edges are stored once, dealt by source.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.scalars import six
from quern.operators import blocks
from quern.operators.components import connected_components
from quern.plans.tables import appended, merged, named_path, split_join, written
from quern.sources.entities import offsets

C = F.col
UNREACHED, INFINITE = -1, 1_000_000_000


@dataclass
class Run:
    """What an iteration did."""

    iterations: int = 0
    converged: bool = False
    edge_iterations: int = 0
    active_visits: int = 0
    max_frontier: int = 0


def _start(spark: SparkSession, source: int, value: str) -> DataFrame:
    return spark.range(1).select(F.lit(source).cast("long").alias("node"), F.lit(0).cast("long").alias(value))


def checked(edges: DataFrame, nodes: int) -> DataFrame:
    """``edges`` whose ends are all 0 .. nodes - 1; an edge beyond fails the job that reads it."""
    if nodes < 0:
        raise ValueError("node_count must be non-negative")
    ok = C("src").between(0, nodes - 1) & C("dst").between(0, nodes - 1)
    text = F.concat(F.lit("edge outside the node range: "), C("src").cast("string"), F.lit(" -> "), C("dst").cast("string"))
    return edges.withColumn("src", F.when(ok, C("src")).otherwise(F.raise_error(text)))


# Compressed rows


def compressed(edges: DataFrame, nodes: int, distinct: bool = True) -> tuple[DataFrame, DataFrame]:
    """(node, offset) for 0 .. nodes and (edge_index, src, dst) sorted by (src, dst); repeats are removed if ``distinct``."""
    e = checked(edges.select("src", "dst"), nodes)
    e = written(e.distinct() if distinct else e, "csr")
    degree = e.groupBy("src").agg(F.count("*").alias("n"))
    every = e.sparkSession.range(nodes + 1).select(C("id").alias("src"))
    rows = offsets(every.join(degree, "src", "left").fillna(0, ["n"])).select(C("src").alias("node"), C("first").alias("offset"))
    own = Window.partitionBy("src").orderBy("dst")
    ranked = e.withColumn("k", F.row_number().over(own) - 1).join(rows.withColumnRenamed("node", "src"), "src")
    return rows, ranked.select((C("offset") + C("k")).alias("edge_index"), "src", "dst")


def csr_error(rows: DataFrame, edges: DataFrame, nodes: int) -> str | None:
    """The first rule that compressed rows break, or None."""
    if nodes < 0:
        return "node_count must be non-negative"
    m, n = edges.count(), rows.count()
    if not n:
        return "row_offsets must contain at least the zero sentinel"
    if n != nodes + 1:
        return "row_offsets size must equal node_count + 1"
    by = rows.withColumnRenamed("offset", "o")
    after = by.select((C("node") - 1).alias("node"), C("o").alias("next"))
    pairs = by.join(after, "node", "left")
    f = pairs.agg(
        F.max(F.when(C("node") == 0, C("o"))).alias("first"), F.max(F.when(C("node") == nodes, C("o"))).alias("last"), F.count_if((C("o") < 0) | (C("o") > m)).alias("outside"), F.count_if(C("next") < C("o")).alias("falls")
    ).first()
    if f["first"] != 0:
        return "row_offsets[0] must be zero"
    if f["outside"]:
        return "row offset is outside the column_indices range"
    if f["falls"]:
        return "row_offsets must be non-decreasing"
    if f["last"] != m:
        return "last row offset must equal edge_count"
    if not edges.where(~C("dst").between(0, nodes - 1)).isEmpty():
        return "column index target is outside the node range"
    return None


def out_degree(rows: DataFrame, node: int) -> int:
    found = rows.where(C("node").isin(node, node + 1)).orderBy("node").collect()
    if node < 0 or len(found) != 2:
        raise IndexError("CSR node id is out of range")
    return found[1]["offset"] - found[0]["offset"]


# Degrees


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree) of every node; repeats of an edge count."""
    own = edges.groupBy(C("src").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.select("node").join(own, "node", "left").fillna(0, ["degree"])


def degree_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return degrees(edges, nodes).agg(
        F.count("*").alias("node_count"), F.sum("degree").alias("edge_count"), F.min("degree").alias("min_out_degree"), F.max("degree").alias("max_out_degree"),
        F.avg("degree").alias("mean_out_degree"), F.count_if(C("degree") == 0).alias("zero_out_degree_count"),
    )


def degree_histogram(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(degree, nodes) for every degree from 0 to the largest; degrees that no node has count 0."""
    own = written(degrees(edges, nodes).groupBy("degree").agg(F.count("*").alias("nodes")), "degrees")
    most = own.agg(F.max("degree")).first()[0]
    whole = edges.sparkSession.range(0 if most is None else most + 1).select(C("id").alias("degree"))
    return whole.join(own, "degree", "left").fillna(0, ["nodes"])


# Traversal


def bfs(edges: DataFrame, source: int, nodes: DataFrame | None = None, run: Run | None = None) -> DataFrame:
    """(node, depth) of all nodes reached, and of all ``nodes`` if given, those not reached with depth -1; by blocks, so a round for each block border on a path."""
    seen = blocks.distances(blocks.store(edges.select("src", "dst")), source, run).withColumnRenamed("distance", "depth")
    return seen if nodes is None else nodes.select("node").join(seen, "node", "left").fillna(UNREACHED, ["depth"])


def bfs_rounds(edges: DataFrame, source: int, nodes: DataFrame | None = None, max_rounds: int | None = None, run: Run | None = None) -> DataFrame:
    """As ``bfs``, level by level: a join for each level, for wide and shallow graphs."""
    spark = edges.sparkSession
    edges = written(edges.select("src", "dst").repartition("src"), "edges")
    front = _start(spark, source, "depth")
    path = named_path(spark, "seen")
    seen = appended(front, path)
    depth = 0
    while True:
        depth += 1
        if max_rounds and depth > max_rounds:
            raise RuntimeError(f"the traversal did not end in {max_rounds} rounds")
        to = front.join(edges, front["node"] == edges["src"]).select(C("dst").alias("node")).distinct()
        front = written(to.join(seen, "node", "left_anti").select("node", F.lit(depth).cast("long").alias("depth")), "front")
        size = front.count()
        if not size:
            break
        if run:
            run.iterations, run.active_visits, run.max_frontier = depth, run.active_visits + size, max(run.max_frontier, size)
        seen = appended(front, path)
    if run:
        run.converged = True
    return seen if nodes is None else nodes.select("node").join(seen, "node", "left").fillna(UNREACHED, ["depth"])


def bfs_levels(depths: DataFrame, edges: DataFrame) -> DataFrame:
    """(depth, frontier_size, edge_visits) of each level."""
    d = degrees(edges, depths.where(C("depth") >= 0)).join(depths, "node")
    return d.groupBy("depth").agg(F.count("*").alias("frontier_size"), F.sum("degree").alias("edge_visits"))


def bfs_profile(depths: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of what the traversal met; ``depths`` must hold all nodes for the checksum."""
    levels = bfs_levels(depths, edges).agg(
        F.sum("frontier_size").alias("reached_count"), F.max("depth").alias("max_distance"), F.count("*").alias("frontier_level_count"), F.max("frontier_size").alias("max_frontier_size"),
        F.sum("edge_visits").alias("reached_edge_visits"), F.max("edge_visits").alias("max_frontier_edge_visits"), F.avg("frontier_size").alias("mean_frontier_size"),
        F.avg("edge_visits").alias("mean_frontier_edge_visits"),
    )
    levels = levels.withColumn("mean_reached_out_degree", C("reached_edge_visits") / C("reached_count"))
    levels = levels.withColumn("frontier_width_to_depth", F.when(C("max_distance") > 0, C("max_frontier_size") / C("max_distance")).otherwise(0.0))
    return levels.crossJoin(F.broadcast(depths.agg(F.sum(C("depth") * (C("node") + 1)).alias("checksum"))))


# Components


def components(edges: DataFrame, nodes: DataFrame | None = None, run: Run | None = None) -> DataFrame:
    """(node, label): the smallest node of each component, by star contraction in few rounds whatever the diameter."""
    found = connected_components(edges.select("src", "dst"), "src", "dst", run).withColumnRenamed("component", "label")
    if nodes is None:
        ends = edges.select(C("src").alias("node")).union(edges.select(C("dst").alias("node")))
        nodes = ends.distinct()
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def forest(edges: DataFrame) -> DataFrame:
    """(src, dst): a forest of each partition's edges by union and find, with the same components in fewer edges."""

    def run(batches):
        above: dict[int, int] = {}

        def root(v):
            while above.setdefault(v, v) != v:
                above[v] = above[above[v]]
                v = above[v]
            return v

        for b in batches:
            for u, v in zip(b["src"].to_pylist(), b["dst"].to_pylist()):
                a, z = sorted((root(u), root(v)))
                above[z] = a
        own = [(v, root(v)) for v in above]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in own if x[0] != x[1]], pa.int64()) for k in (0, 1)], ["src", "dst"])

    return edges.select(C("src").cast("long").alias("src"), C("dst").cast("long").alias("dst")).mapInArrow(run, "src long, dst long")


def forest_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """As ``components``, with the edges of each partition cut to a forest first; its memory grows with the nodes that a partition meets."""
    if nodes is None:
        nodes = edges.select(C("src").alias("node")).union(edges.select(C("dst").alias("node"))).distinct()
    return components(forest(edges), nodes)


def propagated_components(edges: DataFrame, nodes: DataFrame, max_rounds: int | None = None) -> tuple[DataFrame, Run]:
    """(node, label) by the minimum over neighbours and one jump along labels a round; a round for each step of the diameter at most.

    With ``max_rounds`` labels may be unfinished, and then ``Run.converged`` is false.
    """
    edges = written(edges.select("src", "dst").union(edges.select(C("dst").alias("src"), C("src").alias("dst"))).distinct(), "edges")
    labels, run, m = written(nodes.select("node", C("node").alias("label")), "labels"), Run(), edges.count()
    total = labels.count()
    while not run.converged and (max_rounds is None or run.iterations < max_rounds):
        near = edges.join(merged(labels), edges["dst"] == labels["node"]).groupBy("src").agg(F.min("label").alias("near"))
        low = labels.join(merged(near), labels["node"] == near["src"], "left").select("node", F.least("label", "near").alias("low"), C("label").alias("old"))
        low = written(low, "low")
        # Most nodes share a few labels at last, so those of many nodes are broadcast, and all others merged.
        up = merged(labels.select(C("node").alias("low"), C("label").alias("jump"))).join(low.groupBy("low").agg(F.count("*").alias("n")), "low")
        new = written(split_join(low, up, "low", "n", total).select("node", F.least("low", "jump").alias("label"), "old"), "labels")
        run.iterations, run.edge_iterations = run.iterations + 1, run.edge_iterations + m
        run.converged = new.where("label <> old").isEmpty()
        labels = new.select("node", "label")
    return labels, run


def normalised(labels: DataFrame) -> DataFrame:
    """Any labels as the smallest node that has them."""
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return labels.join(least, "label").select("node", C("least").alias("label"))


def component_stats(labels: DataFrame) -> DataFrame:
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"), F.sum((C("node") + 1) * (C("label") + 1)).alias("check"))
    return sizes.agg(
        F.count("*").alias("component_count"), F.max("size").alias("largest_component"), F.count_if(C("size") == 1).alias("isolated_node_count"), F.sum("check").alias("checksum")
    )


# Shortest paths


def shortest_paths(edges: DataFrame, source: int, method: str = "frontier", delta: int = 16, max_rounds: int | None = None) -> tuple[DataFrame, Run]:
    """(node, distance) of all nodes reached from ``source`` over non-negative whole weights, and how the run went.

    Methods, all exact: ``global`` relaxes every edge of a reached node a round; ``frontier`` those of nodes whose distance fell; ``delta``
    those among them in the lowest bucket of ``delta`` distances; ``light_heavy`` closes a bucket over edges of at most ``delta`` first and
    then relaxes the others of all nodes settled in it once; ``blocks`` settles blocks of compressed rows with priority queues. Falls are appended to one log, whose minimum is a node's distance.
    """
    if method not in ("global", "frontier", "delta", "light_heavy", "blocks"):
        raise ValueError(f"unknown method: {method}")
    if delta <= 0:
        raise ValueError("delta must be positive")
    spark, run = edges.sparkSession, Run()
    if method == "blocks":
        return blocks.distances(blocks.store(edges), source, run, max_rounds), run
    edges = written(edges.select("src", "dst", C("weight").cast("long").alias("weight")).repartition("src"), "edges")
    light, heavy = edges.where(C("weight") <= delta), edges.where(C("weight") > delta)
    path = named_path(spark, "paths")
    log = appended(_start(spark, source, "distance"), path)

    def distances() -> DataFrame:
        return log.groupBy("node").agg(F.min("distance").alias("distance"))

    def relaxed(active: DataFrame, over: DataFrame) -> DataFrame:
        """The nodes whose distance falls, written and appended to the log."""
        nonlocal log
        size = active.count()
        run.iterations, run.active_visits, run.max_frontier = run.iterations + 1, run.active_visits + size, max(run.max_frontier, size)
        if max_rounds and run.iterations > max_rounds:
            raise RuntimeError(f"the paths did not converge in {max_rounds} rounds")
        to = active.join(over, active["node"] == over["src"]).groupBy(C("dst").alias("node")).agg(F.min(C("distance") + C("weight")).alias("new"), F.count("*").alias("edges"))
        to = written(to.join(distances(), "node", "left").where("distance is null or new < distance").select("node", C("new").alias("distance"), "edges"), "falls")
        run.edge_iterations += to.agg(F.coalesce(F.sum("edges"), F.lit(0))).first()[0]
        fell = to.select("node", "distance")
        if not fell.isEmpty():
            log = appended(fell, path)
        return fell

    bucket = F.floor(C("distance") / delta)
    front = log
    while not front.isEmpty():
        if method == "global":
            front = relaxed(written(distances(), "all"), edges)
        elif method == "frontier":
            front = relaxed(front, edges)
        else:
            low = front.agg(F.min(bucket)).first()[0]
            now, later = front.where(bucket == low), front.where(bucket != low)
            if method == "delta":
                fell = relaxed(now, edges)
            else:
                settled, fell = now, None
                while not now.isEmpty():
                    fell = relaxed(now, light)
                    now, rest = fell.where(bucket == low), fell.where(bucket != low)
                    later, settled = later.union(rest), settled.union(now)
                own = settled.groupBy("node").agg(F.min("distance").alias("distance"))
                fell = relaxed(written(own, "settled"), heavy)
            both = later.union(fell).groupBy("node").agg(F.min("distance").alias("distance"))
            front = written(both, "front")
    run.converged = True
    return distances(), run


def with_unreached(distances: DataFrame, nodes: DataFrame, value: int = INFINITE) -> DataFrame:
    return nodes.select("node").join(distances, "node", "left").fillna(value, ["distance"])


def path_stats(distances: DataFrame) -> DataFrame:
    """Of all nodes, those not reached at INFINITE: reached nodes, the farthest one, and a checksum that counts them as -1."""
    ok = C("distance") < INFINITE
    return distances.agg(
        F.count_if(ok).alias("reached_count"), F.coalesce(F.max(F.when(ok, C("distance"))), F.lit(0)).alias("max_finite_distance"),
        F.sum(F.when(ok, C("distance")).otherwise(-1) * (C("node") + 1)).alias("checksum"),
    )


def guard(kind: str, nodes: int, max_iterations: int = 0, **p) -> int:
    """Rounds that a graph of this kind may take at most: so many as asked for, or what its shape needs and some more."""
    if max_iterations > 0:
        return max_iterations
    if kind == "chain":
        return max(1, nodes)
    if kind in ("grid", "grid_components", "grids"):
        return max(1, p["width"] + p["height"] + 8)
    if kind == "layered":
        return max(1, p["layers"] + 4)
    if kind in ("chains", "chain_components"):
        return max(1, p["size"] + 8)
    low = 32 if kind == "random" else 64
    return max(low, min(2048, nodes))


def local_paths(edges: DataFrame, source: int) -> DataFrame:
    """(node, distance) by priority queues within blocks; a small graph is one block, and so one queue."""
    return blocks.distances(blocks.store(edges), source)


def choose_backend(depth: int) -> str:
    """Rounds of joins for shallow graphs, blocks for deep ones."""
    return "rounds" if depth <= 100 else "blocks"


def described(run: Run) -> dict[str, str]:
    """A run as metadata texts, by the names that analyses read."""
    names = {"active_visits": "active_frontier_node_visits", "max_frontier": "max_frontier_size"}
    return {names.get(k, k): str(v).lower() for k, v in vars(run).items()} | {"frontier_overflow": "false"}


def summary_text(stats: DataFrame) -> DataFrame:
    """One row of numbers as texts, reals with six decimals."""
    return stats.select(*[(six(C(n)) if t == "double" else C(n).cast("string")).alias(n) for n, t in stats.dtypes])
