"""Deterministic graphs: DataFrames of edges (src, dst), made from ranges without a loop over nodes.

Generators give each directed edge once; ``weighted`` numbers edges by (src, dst) and adds weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.scalars import U32, edge_weight, lcg_steps, multiply_u32
from quern.sources.entities import edge_index

GOLDEN, MIX = 0x9E3779B9, 0x85EBCA6B
# Other names of the kinds.
NAMES = {"random_sparse": "random", "chain_components": "chains", "grids": "grid_components", "random_clusters": "clusters", "mixed_components": "mixed"}


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _nodes(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("v"))


def _edges(nodes: DataFrame, *pairs: tuple[Column, Column, Column | None], both: bool = True) -> DataFrame:
    """One edge (a, b), and (b, a) if ``both``, for each (a, b, condition) and node."""
    each = [F.when(ok, F.struct(a.cast("long").alias("src"), b.cast("long").alias("dst"))) for a, b, ok in pairs]
    if both:
        each += [F.when(ok, F.struct(b.cast("long").alias("src"), a.cast("long").alias("dst"))) for a, b, ok in pairs]
    out = nodes.select(F.explode(F.array_compact(F.array(*each))).alias("e")).select("e.*")
    return out.where("src <> dst")


def chain(spark: SparkSession, n: int, both: bool = True) -> DataFrame:
    _check(n >= 0, "a chain needs a node count of 0 or more")
    v = F.col("v")
    return _edges(_nodes(spark, n), (v, v + 1, v + 1 < n), both=both)


def _grid(nodes: DataFrame, node: Column, place: Column, width: int, height: int, both: bool) -> DataFrame:
    x, y = place % width, F.floor(place / width)
    return _edges(nodes, (node, node + 1, x + 1 < width), (node, node + width, y + 1 < height), both=both)


def grid(spark: SparkSession, width: int, height: int, both: bool = True) -> DataFrame:
    _check(width >= 0 and height >= 0, "a grid needs sides of 0 or more")
    return _grid(_nodes(spark, width * height), F.col("v"), F.col("v"), max(width, 1), height, both)


def layered(spark: SparkSession, layers: int, width: int, fanout: int) -> DataFrame:
    """Node p of a layer has edges to the nodes p + layer, p + layer + 1 ... of the next one, modulo its width."""
    _check(layers >= 0 and width >= 0 and fanout >= 0, "layers, width and fanout are 0 or more")
    _check(layers == 0 or (width > 0 and fanout <= width), "the fanout exceeds the nodes of a layer")
    n = _nodes(spark, max(layers - 1, 0) * width)
    if not fanout:
        return n.select("v", F.col("v").alias("dst")).toDF("src", "dst").limit(0)
    place, layer = F.col("v") % max(width, 1), F.floor(F.col("v") / max(width, 1))
    n = n.select("v", place.alias("p"), layer.alias("l"), F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("k"))
    return n.select(F.col("v").alias("src"), ((F.col("l") + 1) * width + (F.col("p") + F.col("l") + F.col("k")) % width).alias("dst"))


def _drawn(nodes: DataFrame, state: Column, own: Column, size: int, degree: int) -> DataFrame:
    """``nodes`` with ``target``: the first ``degree`` distinct numbers below ``size``, not the node's ``own``, of its generator."""
    steps = lcg_steps(4 * degree + 64)  # the driest case needs some more than ``degree``; too few are an error

    def draw(a: int, c: int) -> Column:
        return ((multiply_u32(a, F.col("_s")) + c).bitwiseAND(U32) % size).cast("long")

    drawn = F.array_distinct(F.array_remove(F.array(*[draw(a, c) for a, c in steps]), own.cast("long")))
    targets = F.when(F.size(drawn) >= degree, F.slice(drawn, 1, degree)).otherwise(F.raise_error(F.lit("a node drew too few targets")))
    if degree > size // 8:  # nearly all targets: the draws may not reach them, so they go on until they do

        def more(a, _):
            s = (a["s"] * 1664525 + 1013904223).bitwiseAND(U32)
            t = (s % size).cast("long")
            new = (F.size(a["t"]) < degree) & (t != own) & ~F.array_contains(a["t"], t)
            return F.struct(s.alias("s"), F.when(new, F.array_append(a["t"], t)).otherwise(a["t"]).alias("t"))

        limit = 64 * size + 64
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(limit)), F.struct(F.col("_s").alias("s"), F.array().cast("array<bigint>").alias("t")), more, lambda a: a["t"])
        targets = F.when(F.size(walk) >= degree, walk).otherwise(F.raise_error(F.lit("a node drew too few targets")))
    return nodes.withColumn("_s", state).withColumn("target", F.explode(targets)).drop("_s")


def random_sparse(spark: SparkSession, n: int, degree: int, seed: int) -> DataFrame:
    """Every node has ``degree`` distinct targets, none of them itself."""
    _check(n >= 0 and degree >= 0, "nodes and degree are 0 or more")
    _check(degree <= max(0, n - 1), "the degree exceeds the distinct targets other than the node itself")
    if not degree:
        return _nodes(spark, 0).select(F.col("v").alias("src"), F.col("v").alias("dst"))
    state = multiply_u32(GOLDEN, F.col("v") + 1).bitwiseXOR(seed & U32)
    return _drawn(_nodes(spark, n), state, F.col("v"), n, degree).select(F.col("v").alias("src"), F.col("target").alias("dst"))


def _placed(spark: SparkSession, components: int, size: int) -> DataFrame:
    _check(components >= 0 and size >= 0, "components and their size are 0 or more")
    _check(components * size < 1 << 31, "the graph has too many nodes")
    v = F.col("v")
    return _nodes(spark, components * size).select("v", F.floor(v / max(size, 1)).alias("c"), (v % max(size, 1)).alias("p"))


def chain_components(spark: SparkSession, components: int, size: int) -> DataFrame:
    v = F.col("v")
    return _edges(_placed(spark, components, size), (v, v + 1, F.col("p") + 1 < size))


def grid_components(spark: SparkSession, components: int, width: int, height: int) -> DataFrame:
    return _grid(_placed(spark, components, width * height), F.col("v"), F.col("p"), max(width, 1), height, True)


def random_clusters(spark: SparkSession, components: int, size: int, degree: int, seed: int) -> DataFrame:
    """Each cluster: a chain that connects it, and ``degree`` random chords of every node, both ways; repeated edges once."""
    _check(degree <= max(0, size - 1), "the degree exceeds the size of a cluster less one")
    placed = _placed(spark, components, size)
    backbone = chain_components(spark, components, size)
    if not degree:
        return backbone
    state = multiply_u32(GOLDEN, F.col("c") + 1).bitwiseXOR(multiply_u32(MIX, F.col("p") + 1)).bitwiseXOR(seed & U32)
    chords = _drawn(placed, state, F.col("p"), size, degree)
    return backbone.union(_edges(chords, (F.col("v"), F.col("v") - F.col("p") + F.col("target"), F.lit(True)))).distinct()


def mixed_components(spark: SparkSession, components: int, size: int) -> DataFrame:
    """Paths, stars and rings with skips in turn; every fifth component keeps its size, the others leave up to four nodes alone."""
    n, v, p, c = _placed(spark, components, size), F.col("v"), F.col("p"), F.col("c")
    n = n.withColumn("own", F.greatest(F.lit(1), size - c % 5)).where("p < own and own > 1")
    base = v - p
    path = _edges(n.where("c % 3 = 0"), (v, v + 1, p + 1 < F.col("own")))
    star = _edges(n.where("c % 3 = 1"), (base, v, p > 0))
    ring = _edges(n.where("c % 3 = 2"), (v, base + (p + 1) % F.col("own"), F.lit(True)), (v, v + 2, p + 2 < F.col("own")))
    return path.union(star).union(ring).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of all edges, without loops and repeats."""
    e = edges.select("src", "dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def weighted(edges: DataFrame) -> DataFrame:
    """(edge_index, src, dst, weight): repeats removed, numbered by (src, dst), weights 1 .. 31."""
    e = edge_index(edges.select("src", "dst").distinct())
    return e.select("edge_index", "src", "dst", edge_weight(F.col("src"), F.col("dst"), F.col("edge_index")).alias("weight"))


def make(spark: SparkSession, kind: str, **p) -> tuple[DataFrame, int]:
    """Edges and number of nodes of a graph by its kind's name or alias."""
    makers = {
        "chain": lambda: (chain(spark, p["nodes"]), p["nodes"]),
        "grid": lambda: (grid(spark, p["width"], p["height"]), p["width"] * p["height"]),
        "layered": lambda: (layered(spark, p["layers"], p["width"], p["fanout"]), p["layers"] * p["width"]),
        "random": lambda: (random_sparse(spark, p["nodes"], p["degree"], p["seed"]), p["nodes"]),
        "chains": lambda: (chain_components(spark, p["components"], p["size"]), p["components"] * p["size"]),
        "grid_components": lambda: (grid_components(spark, p["components"], p["width"], p["height"]), p["components"] * p["width"] * p["height"]),
        "clusters": lambda: (random_clusters(spark, p["components"], p["size"], p["degree"], p["seed"]), p["components"] * p["size"]),
        "mixed": lambda: (mixed_components(spark, p["components"], p["size"]), p["components"] * p["size"]),
    }
    kind = NAMES.get(kind, kind)
    if kind not in makers:
        raise ValueError(f"unknown graph kind: {kind}")
    return makers[kind]()


# How a graph's parameters read, by kind; of single graphs, and of graphs with components.
SHAPES = {"chain": "chain_nodes={nodes}", "grid": "grid={width}x{height}", "layered": "layers={layers}, nodes_per_layer={width}, fanout={fanout}", "random": "random_nodes={nodes}, out_degree={degree}, seed={seed}"}
PARTED = {"grid_components": "components={components}, grid={width}x{height}", "clusters": "components={components}, component_size={size}, random_out_degree={degree}, seed={seed}"}


def shape(kind: str, **p) -> str:
    """A graph's parameters as one line of text."""
    kind = NAMES.get(kind, kind)
    if kind in SHAPES:
        return SHAPES[kind].format(**p)
    return PARTED.get(kind, "components={components}, component_size={size}").format(**p)


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions of the distinct part-supplier pairs; suppliers are -1 - key."""
    e = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst")).distinct()
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def layout(nodes: DataFrame, kind: str, width: int = 1, size: int = 1) -> DataFrame:
    """Places (x, y) to draw nodes at: a line, a grid or layers of ``width``, a circle of ``size``, or one circle for each component of ``size``."""
    v = F.col("node").cast("double")
    if kind == "line":
        return nodes.withColumns({"x": v, "y": F.lit(0.0)})
    if kind in ("grid", "layers"):
        a, b = v % width, F.floor(v / width).cast("double")
        return nodes.withColumns({"x": a, "y": -b} if kind == "grid" else {"x": b, "y": -a})
    if kind not in ("circle", "components"):
        raise ValueError(f"unknown layout: {kind}")
    turn = 2 * 3.141592653589793 * (v % size) / size
    apart = F.lit(0.0) if kind == "circle" else F.floor(v / size) * 3.0
    return nodes.withColumns({"x": F.cos(turn) + apart, "y": F.sin(turn)})


def first_appearance(labels: DataFrame) -> DataFrame:
    """``labels`` (node, label) with ``component_index``, from 0 in the order of the smallest labels, by offsets instead of a window over all rows."""
    from quern.sources.entities import offsets

    each = labels.select(F.col("label").alias("src"), F.lit(1).alias("n")).distinct()
    return labels.join(offsets(each).select(F.col("src").alias("label"), F.col("first").alias("component_index")), "label")


