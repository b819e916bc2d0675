"""Graphs: generators, traversal, components and paths against known answers and each other."""

import pytest
from pyspark.sql import functions as F

from quern.operators import graph as go
from quern.sources import graphs as gr


def nodes(spark, n):
    return spark.range(n).select(F.col("id").alias("node"))


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


def values(df, column):
    return [r[column] for r in df.orderBy("node").collect()]


def test_generators(spark):
    assert gr.chain(spark, 5).count() == 8 and gr.chain(spark, 5, both=False).count() == 4
    s = go.degree_stats(gr.grid(spark, 3, 2), nodes(spark, 6)).first()
    assert (s["edge_count"], s["min_out_degree"], s["max_out_degree"]) == (14, 2, 3)
    s = go.degree_stats(gr.layered(spark, 3, 4, 2), nodes(spark, 12)).first()
    assert (s["edge_count"], s["zero_out_degree_count"]) == (16, 4)
    e = gr.random_sparse(spark, 10, 3, 12345)
    s = go.degree_stats(e, nodes(spark, 10)).first()
    assert (s["edge_count"], s["min_out_degree"], s["max_out_degree"]) == (30, 3, 3) and e.where("src = dst").count() == 0 and e.distinct().count() == 30
    assert gr.random_sparse(spark, 5, 4, 1).count() == 20 and gr.chain_components(spark, 3, 4).count() == 18


@pytest.mark.parametrize("make", [lambda s: gr.layered(s, 3, 4, 5), lambda s: gr.layered(s, 3, 0, 1), lambda s: gr.random_sparse(s, 0, 1, 1), lambda s: gr.random_sparse(s, 4, 4, 1), lambda s: gr.make(s, "tree"), lambda s: gr.random_clusters(s, 2, 3, 3, 1)])
def test_generators_refuse(spark, make):
    with pytest.raises(ValueError):
        make(spark)


@pytest.mark.parametrize(
    "kind, sizes, want",
    [
        ("clusters", {"components": 4, "size": 32, "degree": 3, "seed": 0xC0FFEE}, (874, 4, 568384)),
        ("mixed", {"components": 4, "size": 32}, (294, 10, 587626)),
        ("random_clusters", {"components": 6, "size": 24, "degree": 3, "seed": 12648430}, (972, 6, 878760)),
    ],
)
def test_component_graphs(spark, kind, sizes, want):
    e, n = gr.make(spark, kind, **sizes)
    s = go.component_stats(go.components(e, nodes(spark, n))).first()
    assert (e.count(), s["component_count"], s["checksum"]) == want


def test_compressed_rows(spark):
    rows, cols = go.compressed(edges(spark, (0, 2), (0, 1), (0, 1), (1, 2)), 3)
    assert [r["offset"] for r in rows.orderBy("node").collect()] == [0, 2, 3, 3] and [r["dst"] for r in cols.orderBy("edge_index").collect()] == [1, 2, 2]
    assert go.csr_error(rows, cols, 3) is None and [go.out_degree(rows, v) for v in range(3)] == [2, 1, 0]
    with pytest.raises(IndexError):
        go.out_degree(rows, 3)
    for bad, n in (((0, 2), 2), ((-1, 1), 2)):
        with pytest.raises(Exception, match="outside the node range"):
            go.compressed(edges(spark, bad), n)
    with pytest.raises(ValueError):
        go.checked(edges(spark, (0, 1)), -1)


def test_compressed_rows_that_break_a_rule(spark):
    def check(offsets, targets, n):
        rows = spark.createDataFrame(list(enumerate(offsets)), "node long, offset long")
        return go.csr_error(rows, spark.createDataFrame([(i, 0, t) for i, t in enumerate(targets)], "edge_index long, src long, dst long"), n)

    assert check([0, 1], [1], 2) == "row_offsets size must equal node_count + 1"
    assert check([1, 1], [0], 1) == "row_offsets[0] must be zero"
    assert check([0, 5, 1], [0], 2) == "row offset is outside the column_indices range"
    assert check([0, 2, 1, 2], [0, 0], 3) == "row_offsets must be non-decreasing"
    assert check([0, 1], [0, 0], 1) == "last row offset must equal edge_count"
    assert check([0, 1, 1], [7], 2) == "column index target is outside the node range"
    assert check([], [], -1) == "node_count must be non-negative" and check([0, 1, 1], [1], 2) is None


def test_traversal(spark):
    assert values(go.bfs(gr.chain(spark, 5), 0, nodes(spark, 5)), "depth") == [0, 1, 2, 3, 4]
    e = edges(spark, (0, 1))
    d = go.bfs(e, 0, nodes(spark, 4))
    assert values(d, "depth") == [0, 1, -1, -1]
    p = go.bfs_profile(d, e).first()
    assert (p["reached_count"], p["reached_edge_visits"], p["checksum"]) == (2, 1, 2 - 3 - 4)
    with pytest.raises(RuntimeError):
        go.bfs_rounds(gr.chain(spark, 9), 0, max_rounds=3)


def test_components(spark):
    e = gr.symmetric(edges(spark, (0, 1), (1, 2), (3, 4), (4, 4)))
    stars, (spread, run) = go.components(e, nodes(spark, 6)), go.propagated_components(e, nodes(spark, 6))
    assert values(stars, "label") == values(spread, "label") == [0, 0, 0, 3, 3, 5] and run.converged
    s = go.component_stats(stars).first()
    assert (s["component_count"], s["largest_component"], s["isolated_node_count"]) == (3, 3, 1)
    odd = spark.createDataFrame(list(enumerate([10, 10, 7, 7, 7, 99])), "node long, label long")
    assert values(go.normalised(odd), "label") == [0, 0, 2, 2, 2, 5]
    assert values(gr.first_appearance(go.normalised(odd)), "component_index") == [0, 0, 1, 1, 1, 2]
    assert go.propagated_components(gr.chain(spark, 40), nodes(spark, 40), max_rounds=2)[1].converged is False


def test_shortest_paths_agree(spark):
    e = go.written(gr.weighted(gr.random_sparse(spark, 60, 3, 9)), "graph")
    want = values(go.with_unreached(go.local_paths(e, 0), nodes(spark, 60)), "distance")
    for method in ("global", "frontier", "delta", "light_heavy"):
        found, run = go.shortest_paths(e, 0, method, delta=8)
        assert values(go.with_unreached(found, nodes(spark, 60)), "distance") == want and run.converged and run.iterations > 0
    with pytest.raises(ValueError):
        go.shortest_paths(e, 0, "nonsense")
    with pytest.raises(RuntimeError):
        go.shortest_paths(e, 0, "frontier", max_rounds=1)


def test_weights_and_known_paths(spark):
    for kind, sizes, want in (("chain", {"nodes": 256}, (256, 4263, 93779822)), ("grid", {"width": 16, "height": 16}, (256, 279, 5696473)), ("random", {"nodes": 1024, "degree": 8, "seed": 0xA11CE}, (1024, 53, 15711276))):
        e, n = gr.make(spark, kind, **sizes)
        w = gr.weighted(e)
        assert w.where("weight < 1 or weight > 31").count() == 0
        s = go.path_stats(go.with_unreached(go.local_paths(w, 0), nodes(spark, n))).first()
        assert (s["reached_count"], s["max_finite_distance"], s["checksum"]) == want


def test_guards_and_backends():
    assert go.guard("chain", 9) == 9 and go.guard("random", 10**6) == 2048 and go.guard("random", 5) == 32 and go.guard("mixed", 5) == 64
    assert go.guard("grid", 9, width=3, height=3) == 14 and go.guard("layered", 9, layers=3) == 7 and go.guard("chains", 9, size=3) == 11 and go.guard("chain", 9, 4) == 4
    assert go.choose_backend(5) == "rounds" and go.choose_backend(5000) == "blocks"


def test_layouts(spark):
    n = nodes(spark, 6)
    for kind in ("line", "grid", "layers", "circle", "components"):
        assert gr.layout(n, kind, width=3, size=3).select("x", "y").distinct().count() == (3 if kind == "circle" else 6)
    with pytest.raises(ValueError):
        gr.layout(n, "spiral")
    assert gr.shape("grid", width=2, height=3) == "grid=2x3" and gr.shape("mixed", components=2, size=5) == "components=2, component_size=5"
