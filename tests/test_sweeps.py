"""Sweeps whose rows the analyses read, rows appended over time, and wrong results that are noticed."""

import pytest
from pyspark.sql import functions as F

from quern import cli
from quern.operators import evaluators as ev
from quern.plans import analytics as an
from quern.plans import harness
from quern.sources import results


def swept(spark, tmp_path, benchmark, points):
    rows = harness.sweep(spark, benchmark, points, harness.Config())
    path = str(tmp_path / benchmark)
    results.write_jsonl(results.result_frame(spark, rows), path)
    return results.read_jsonl(spark, path), path


def test_paths_from_sweep_to_recommendation(spark, tmp_path, capsys):
    points = [{"sweep_label": "chain_6_delta40", "graph": "chain", "chain_nodes": "6", "delta": "40"}]
    rows, path = swept(spark, tmp_path, "graph_weighted_relaxation", points)
    found = an.paths(rows).collect()
    assert [(r["graph_kind"], r["nodes"]) for r in found] == [("chain", 6)]
    for r in found:
        assert r["correct_cpu_rows"] == r["correct_gpu_global_rows"] == r["correct_gpu_delta_light_heavy_rows"] == 1
        assert r["gpu_frontier_iterations"] > 0 and r["gpu_global_converged"] and r["gpu_delta_edge_iterations"] > 0 and r["reached_count"] == r["nodes"]
    assert found[0]["shape"] == "chain_nodes=6" and found[0]["global_mismatch_count"] == 0
    best = an.recommended(an.paths(rows)).collect()
    assert all(r["best_backend"] in an.BACKENDS and r["best_ms_per_run"] > 0 for r in best)
    assert {r["delta"] for r in an.delta_tuning(rows).collect()} == {40}
    out = str(tmp_path / "reports")
    assert cli.main(["--analyze", path, "--output", out], spark) == 0 and "best_backend" in capsys.readouterr().out
    assert "chain_6_delta40" in "\n".join(r[0] for r in spark.read.text(out + "/graph_weighted_relaxation_report.md").collect())


def test_traversal_and_components_from_sweep_to_analysis(spark, tmp_path, capsys):
    rows, path = swept(spark, tmp_path, "graph_bfs", [{"sweep_label": "grid_3x2", "graph": "grid", "grid_width": "3", "grid_height": "2"}])
    r = an.bfs(rows).collect()
    assert len(r) == 1 and (r[0]["nodes"], r[0]["shape"], r[0]["frontier_metric_source"], r[0]["max_distance"], r[0]["frontier_level_count"]) == (6, "grid=3x2", "exact", 3, 4)
    assert r[0]["speedup_cpu_over_gpu"] > 0 and cli.main(["--analyze", path, "--require-exact"], spark) == 0
    bare = [x.asDict(recursive=True) | {"metadata": {"graph_kind": "grid"}} for x in rows.drop("place").collect()]
    results.write_jsonl(results.result_frame(spark, bare), path + "-old")
    assert cli.main(["--analyze", path + "-old", "--require-exact"], spark) == 2 and cli.main(["--analyze", path + "-old"], spark) == 0
    rows, _ = swept(spark, tmp_path, "graph_connected_components", [{"sweep_label": "mixed_3x6", "graph": "mixed", "components": "3", "component_size": "6"}])
    c = an.components(rows).first()
    assert c["correct_cpu_rows"] == c["correct_gpu_naive_rows"] == c["correct_gpu_non_naive_rows"] == 1 and c["gpu_naive_converged"] and c["gpu_non_naive_iterations"] > 0
    assert c["shape"] == "components=3, component_size=6" and c["component_count"] > 0 and c["largest_component_size"] == 6


@pytest.mark.parametrize(
    "name, analysis, point, want",
    [
        ("constraint_network", an.constraints, {"tasks": "8", "resources": "4", "candidates": "64"}, ("valid_count", "skill_violations", "forbidden_zone_violations")),
        ("combination_finder", an.combinations, {"items": "12", "k": "3"}, ("combinations", "valid_count", "spread_violations")),
        ("assignment_preprocessing", an.assignment, {"tasks": "8", "resources": "8", "top_k": "2"}, ("feasible_pair_count", "mean_selected_cost", "zone_violations")),
        ("local_search_moves", an.local_search, {"tasks": "8", "resources": "8", "moves": "64"}, ("valid_moves", "no_change_violations", "best_delta")),
        ("scenario_simulation", an.scenarios, {"tasks": "8", "resources": "4", "scenarios": "64"}, ("feasible_ratio", "mean_score", "robustness_score")),
    ],
)
def test_evaluators_from_sweep_to_analysis(spark, tmp_path, name, analysis, point, want):
    rows, _ = swept(spark, tmp_path, name, [point | {"sweep_label": "p"}])
    r = analysis(rows).first()
    assert r["label"] == "p" and r["speedup_cpu_over_gpu"] > 0 and all(r[w] is not None for w in want)


def test_the_last_appended_row_is_the_last(spark, tmp_path):
    path = str(tmp_path / "rows")
    for ms in (1.0, 3.0, 2.0):  # files of other sizes each time
        row = {"benchmark": "local_search_moves", "variant": "cpu", "preset": "l", "repeat": 1, "warmup": 0, "input_size": {"tasks": 1, "resources": 1, "moves": 1}, "total_ms": ms, "kernel_ms": ms, "correct": True, "device": "d" * int(5000 / ms), "metadata": {}}
        results.write_jsonl(results.result_frame(spark, [row]), path)
    rows = results.read_jsonl(spark, path)
    assert an.local_search(rows).first()["cpu_ms_per_run"] == 2.0 and [r["total_ms"] for r in an.report(rows).collect()] == [1.0, 3.0, 2.0]


def test_bad_lines_and_matrices_keep_their_places(spark, tmp_path):
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"benchmark": "a"}\n\nnonsense\n')
    with pytest.raises(Exception, match="line 3 of .*bad.jsonl: nonsense"):
        results.read_jsonl(spark, str(bad)).collect()
    cells = spark.createDataFrame([(r, c, r * 10.0 + c) for r in range(40) for c in range(3) if (r, c) != (7, 1)], "r long, c long, v double")
    path = str(tmp_path / "matrix")
    results.wide(cells, "r", "c", cells["v"], 3).write.text(path)
    got = {(x["row"], x["column"]): x["value"] for x in results.read_matrix(spark, path).collect()}
    assert len(got) == 120 and str(got.pop((7, 1))) == "nan" and all(v == r * 10 + c for (r, c), v in got.items())


def test_a_broken_evaluator_ends_with_code_2(spark, monkeypatch):
    right = ev.evaluate_moves
    monkeypatch.setattr(ev, "evaluate_moves", lambda *e: right(*e).withColumn("delta", F.col("delta") + 1))
    args = ["--benchmark", "local_search_moves", "--set", "moves=64", "--set", "tasks=8", "--set", "resources=8"]
    assert cli.main(args, spark) == 2


def test_every_sweep_has_points_of_its_workload():
    for name, points in harness.SWEEPS.items():
        assert len({p["sweep_label"] for p in points}) == len(points)
        for p in points:
            assert set(p) <= {"sweep_label", *harness.PRESETS[name]["tiny"]} and harness.sizes(name, "tiny", p)
