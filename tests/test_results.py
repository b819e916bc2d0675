"""Result rows: reading, writing, analyses, exports, validation and the command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quern import cli
from quern.plans import analytics as an
from quern.plans import harness
from quern.plans.validate import RULES, Rule, compare, validate
from quern.sources import entities as en
from quern.sources import graphs as gr
from quern.sources import results


def row(benchmark, variant, preset, ms, sizes, meta=None, repeat=1, correct=True, kernel=0.0):
    return {
        "benchmark": benchmark, "variant": variant, "preset": preset, "repeat": repeat, "warmup": 0, "input_size": sizes, "total_ms": ms, "h2d_ms": 0.0, "kernel_ms": kernel, "d2h_ms": 0.0,
        "correct": correct, "device": "d", "notes": "", "metadata": meta or {},
    }


@pytest.fixture
def lines(spark, tmp_path):
    def write(*rows):
        path = tmp_path / "rows.jsonl"
        path.write_text("\n\n".join(json.dumps(r) for r in rows) + "\n  \n")
        return results.read_jsonl(spark, str(path))

    return write


def test_reader_skips_blanks_and_names_bad_lines(spark, lines, tmp_path):
    got = lines(row("a", "cpu", "p", 1.0, {"n": 2}), row("b", "gpu", "p", 2.0, {"n": 2}, {"k": "v"}))
    assert got.count() == 2 and got.where("benchmark = 'b'").first()["metadata"] == {"k": "v"}
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"benchmark": "a"}\n{"benchmark": \n')
    with pytest.raises(Exception, match="invalid result on line"):
        results.read_jsonl(spark, str(bad)).collect()


def test_writer_appends_and_leaves_empty_metadata_out(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = results.result_frame(spark, [row("a", "cpu", 'q"\n', 1.0, {"n": 2})])
    results.write_jsonl(frame, path)
    results.write_jsonl(frame, path)
    text = [r["value"] for r in spark.read.text(path).collect()]
    assert len(text) == 2 and set(json.loads(text[0])["metadata"]) == {"sequence"} and json.loads(text[0])["preset"] == 'q"\n'
    assert results.read_jsonl(spark, path, "a").count() == 2
    results.write_jsonl(frame, path, append=False)
    assert results.read_jsonl(spark, path).count() == 1
    assert "benchmark" in results.console(frame) and results.markdown(an.report(frame.withColumn("place", F.lit(1)))).count("\n") == 2


def one(df):
    assert df.count() == 1
    return df.first()


def test_bfs_analysis(lines):
    s = {"nodes": 10, "edges": 40}
    m = {"graph_kind": "random_sparse", "shape": "x", "max_distance": "4", "reached_count": "10"}
    rows = lines(
        row("graph_bfs", "cpu", "p", 10.0, s, m, repeat=2), row("graph_bfs", "cpu", "p", 7.0, s, m), row("graph_bfs", "cpu", "p", 99.0, s, m, correct=False), row("graph_bfs", "gpu", "p", 3.0, s, m),
        row("graph_bfs", "cpu", "p", 1.0, s, {"graph_kind": "tree"}),
    )
    found = an.bfs(rows)
    r = one(found)
    assert (r["graph_kind"], r["cpu_ms_per_run"], r["gpu_ms_per_run"], r["speedup_cpu_over_gpu"], r["cpu_rows"]) == ("random", 6.0, 3.0, 2.0, 2)
    assert (r["frontier_level_count"], r["mean_frontier_size"], r["mean_reached_out_degree"], r["reached_edge_visits"], r["frontier_width_to_depth"]) == (5.0, 2.0, 4.0, 40.0, 0.4)
    assert r["frontier_metric_source"] == "fallback_estimate" and any("estimated for 1" in x for x in an.bfs_diagnosis(found))
    exact = one(an.bfs(lines(row("graph_bfs", "gpu", "p", 3.0, s, m | {"max_frontier_size": "7"}))))
    assert exact["frontier_metric_source"] == "exact" and exact["max_frontier_size"] == 7.0 and exact["speedup_cpu_over_gpu"] is None
    assert one(an.bfs(lines(row("graph_bfs", "cpu", "p", 3.0, s, {"graph_kind": "grid"}))))["frontier_metric_source"] == "unavailable"


def test_component_analysis(lines):
    s, m = {"nodes": 10, "edges": 40}, {"graph_kind": "chains", "iterations": "3", "converged": "true", "component_count": "2"}
    r = one(an.components(lines(*[row("graph_connected_components", v, "l", ms, s, m, repeat=2) for v, ms in (("cpu", 12.0), ("gpu", 4.0), ("gpu-non-naive", 2.0))])))
    assert (r["graph_kind"], r["speedup_cpu_over_gpu_naive"], r["speedup_cpu_over_gpu_non_naive"], r["gpu_naive_to_non_naive_speedup"]) == ("chain", 3.0, 6.0, 2.0)
    assert (r["gpu_naive_edge_iterations"], r["gpu_naive_converged"], r["component_count"], r["correct_cpu_rows"]) == (120, True, 2, 1)


def test_path_analysis_and_recommendation(lines):
    def point(n, times):
        s, m = {"nodes": n, "edges": 4 * n}, {"graph_kind": "random", "iterations": "40", "mean_out_degree": "4.0", "active_frontier_node_visits": "20"}
        return [row("graph_weighted_relaxation", v, f"n{n}", ms, s, m) for v, ms in times.items()]

    found = an.paths(lines(*point(10, {"cpu": 1.0, "gpu": 4.0, "gpu-frontier": 2.0}), *point(100, {"cpu": 9.0, "gpu": 6.0, "gpu-frontier": 3.0, "gpu-delta-stepping": 3.0})))
    r = {x["nodes"]: x for x in found.collect()}
    assert r[100]["gpu_global_to_frontier_speedup"] == 2.0 and r[100]["gpu_frontier_edge_work_estimate"] == 80.0 and r[10]["gpu_delta_ms_per_run"] is None
    best = {x["nodes"]: x for x in an.recommended(found).collect()}
    assert best[10]["best_backend"] == "cpu" and "rounds" in best[10]["reason"] and best[100]["best_backend"] == "gpu-frontier" and best[100]["best_ms_per_run"] == 3.0
    cross = {(x["variant"], x["nodes"]) for x in an.crossovers(found, ["speedup_cpu_over_gpu_global", "speedup_cpu_over_gpu_frontier"]).collect()}
    assert cross == {("speedup_cpu_over_gpu_global", 100), ("speedup_cpu_over_gpu_frontier", 100)}
    assert an.scaling(found).where("series = 'cpu_ms_per_run'").count() == 2


def test_first_and_last_rows(lines):
    s = {"tasks": 2, "resources": 3, "top_k": 1, "moves": 8, "scenarios": 8}
    m = {"valid_moves": "4", "feasible_scenarios": "8", "infeasible_scenarios": "0"}
    r = one(an.assignment(lines(row("assignment_preprocessing", "cpu", "l", 8.0, s), row("assignment_preprocessing", "cpu", "l", 4.0, s), row("assignment_preprocessing", "cpu", "l", 1.0, s, correct=False), row("assignment_preprocessing", "gpu", "l", 2.0, s))))
    assert (r["cpu_ms_per_run"], r["speedup_cpu_over_gpu"], r["pairs"]) == (4.0, 2.0, 6)
    found = an.local_search(lines(row("local_search_moves", "cpu", "l", 4.0, s, m), row("local_search_moves", "cpu", "l", 1.0, s, m, correct=False), row("local_search_moves", "gpu", "l", 2.0, s, m, kernel=0.5)))
    r = one(found)
    assert (r["cpu_ms_per_run"], r["cpu_correct"], r["gpu_overhead_ms"], r["valid_ratio"], r["gpu_moves_per_ms"]) == (1.0, False, 1.5, 0.5, 4.0)
    assert one(an.plateaus(found))["plateau"] is None
    r = one(an.scenarios(lines(row("scenario_simulation", "cpu", "l", 4.0, s, m), row("scenario_simulation", "gpu", "l", 2.0, s, m, correct=False))))
    assert (r["speedup_cpu_over_gpu"], r["feasible_ratio"], r["one_sided"]) == (None, 1.0, True)


def test_means_and_ratios(lines):
    s, m = {"tasks": 2, "resources": 3, "candidates": 10, "items": 5, "k": 3, "combinations": 10}, {"valid_count": "4", "total_violations": "30", "skill_violations": "2", "risk_violations": "6"}
    rows = lines(row("constraint_network", "cpu", "l", 4.0, s, m), row("constraint_network", "gpu", "l", 2.0, s, m, kernel=1.0), row("combination_finder", "cpu", "l", 4.0, s, m))
    found = an.constraints(rows)
    r = one(found)
    assert (r["valid_ratio"], r["violations_per_candidate"], r["speedup_cpu_over_gpu"], r["mean_kernel_ms"]) == (0.4, 3.0, 2.0, 1.0)
    assert one(an.constraint_diagnostics(rows))["risk_rate"] == 0.6 and one(an.dominant_reason(found))["reason"] == "risk_violations"
    r = one(an.combinations(rows))
    assert (r["valid_count"], r["invalid_count"], r["valid_ratio"], r["gpu_ms_per_run"]) == (4, 6, 0.4, None)


def test_delta_tuning_and_compare(lines):
    rows = lines(row("graph_weighted_relaxation", "gpu", "grid_delta16", 4.0, {}, {"iterations": "3"}, repeat=2), row("graph_weighted_relaxation", "gpu", "grid", 4.0, {}), row("graph_weighted_relaxation", "cpu", "grid", 8.0, {}, repeat=2))
    r = one(an.delta_tuning(rows))
    assert (r["case"], r["delta"], r["ms_per_run"], r["iterations"]) == ("grid", 16, 2.0, 3)
    assert one(an.compared(rows))["speedup"] == 2.0


def test_validation(spark):
    ref = spark.createDataFrame([(0, 0, True, 1.0), (0, 1, False, None), (0, 2, True, 1000.0)], "task_id long, resource_id long, feasible boolean, cost double")
    assert validate("cost_matrix", ref, ref).first()["correct"]
    near = ref.withColumn("cost", F.col("cost") * 1.0000005)
    assert validate("cost_matrix", near, ref).first()["correct"]
    for bad in (ref.withColumn("cost", F.col("cost") + 1), ref.where("resource_id < 2"), ref.union(ref), ref.withColumn("feasible", F.lit(True)), ref.withColumn("cost", F.coalesce("cost", F.lit(1.0)))):
        assert not validate("cost_matrix", bad, ref).first()["correct"]
    # "both" fails only beyond each of the two tolerances.
    off = ref.withColumn("cost", F.col("cost") + 0.001)
    assert compare(off, ref, Rule(("resource_id",), real="cost", absolute=1e-2, relative=1e-9, both=True)).first()["correct"]
    labels = spark.createDataFrame([(0, 0), (1, 0)], "node long, label long")
    r = validate("graph_connected_components", labels, labels).first()
    assert r["correct"] and r["checksum"] == r["reference_checksum"]
    with pytest.raises(ValueError):
        validate("nonsense", ref, ref)
    assert list(RULES) == [n for n in RULES] and set(RULES) == set(harness.WORKLOADS)


def test_exports(spark, tmp_path):
    ids = lambda n: en.numbered(spark, n)
    base = str(tmp_path)
    results.export_cost(base + "/cost", en.cost_tasks(ids(4)), en.cost_resources(ids(3)))
    m = results.read_matrix(spark, base + "/cost/feasible").collect()
    assert len(m) == 12 and {r["value"] for r in m} <= {0.0, 1.0}
    results.export_spatial(base + "/spatial", en.tracks(ids(4)), en.zones(ids(3)))
    results.export_constraints(base + "/cn", en.constraint_tasks(ids(4)), en.constraint_resources(ids(3)), en.constraint_candidates(ids(9), 4, 3))
    assert spark.read.option("header", True).csv(base + "/cn/candidate_evaluations").count() == 9
    results.export_assignment(base + "/ap", en.assignment_tasks(ids(4)), en.assignment_resources(ids(5)), 2)
    assert results.read_csv(spark, base + "/ap/topk_candidates", "task_id long, rank int, resource_id long, cost float").count() == 8
    results.export_moves(base + "/ls", en.search_moves(ids(9), 4, 5), en.search_tasks(ids(4), 5), en.search_resources(ids(5)))
    resources = en.scenario_resources(ids(3))
    results.export_scenarios(base + "/sc", en.scenarios(ids(6), 4, 3), en.base_plan(en.scenario_tasks(ids(4)), resources), resources)
    e = gr.chain_components(spark, 2, 3)
    nodes = spark.range(6).select(F.col("id").alias("node"))
    results.export_graph(base + "/graph", e, nodes, spark.createDataFrame([(v, v // 3 * 3) for v in range(6)], "node long, label long"), {"kind": "chains"})
    assert spark.read.option("header", True).csv(base + "/graph/components").count() == 2 and json.loads(spark.read.text(base + "/graph/metadata.json").first()[0]) == {"kind": "chains"}
    assert os.path.isdir(base + "/spatial/triggered_events")


def test_command_line_errors(capsys):
    for args in (["--preset"], ["--repeat", "0"], ["--repeat", "-1"], ["--warmup", "-1"], ["--set", "x"], ["--nonsense"]):
        with pytest.raises(ValueError):
            cli.parse(args)
        assert cli.main(args) == 1
    c = cli.parse(["--benchmark", "graph_bfs", "--preset", "small", "--repeat", "3", "--warmup", "1", "--no-validate", "--set", "graph=grid", "--set", "source=2"])
    assert (c.benchmark, c.preset, c.repeat, c.warmup, c.validate, c.params) == ("graph_bfs", "small", 3, 1, False, {"graph": "grid", "source": "2"})
    assert cli.main(["--list"]) == 0 and capsys.readouterr().out.split() == harness.WORKLOADS


def test_command_line_runs(spark, tmp_path, capsys, monkeypatch):
    out = str(tmp_path / "rows")
    assert cli.main(["--benchmark", "graph_bfs", "--set", "graph=chain", "--set", "chain_nodes=6", "--set", "sweep_label=six", "--output", out], spark) == 0
    rows = results.read_jsonl(spark, out).collect()
    assert {(r["variant"], r["preset"], r["correct"]) for r in rows} == {("cpu", "six", True), ("gpu", "six", True)}
    assert all(r["metadata"]["max_distance"] == "5" for r in rows)
    assert cli.main(["--benchmark", "nonsense"], spark) == 1 and "unknown benchmark" in capsys.readouterr().err
    assert cli.main(["--benchmark", "graph_bfs", "--preset", "huge"], spark) == 1
    monkeypatch.setattr(harness, "run", lambda spark, config: [row("a", "cpu", "p", 1.0, {}, correct=False)])
    assert cli.main([], spark) == 2 and cli.main(["--no-validate"], spark) == 0


@pytest.mark.parametrize("name", [n for n in harness.WORKLOADS if n not in ("graph_bfs", "graph_weighted_relaxation")])
def test_every_workload_is_right_at_its_smallest(spark, name):
    small = {k: "16" for k in ("values", "tasks", "resources", "tracks", "zones", "candidates", "items", "moves", "scenarios", "component_size")} | {"components": "2", "top_k": "3"}
    rows = harness.run(spark, harness.Config(name, params=small))
    assert rows and all(r["correct"] for r in rows)
    assert harness.sizes("combination_finder", "tiny", {"k": "2"})["k"] == 2
    with pytest.raises(ValueError):
        harness.sizes("combination_finder", "tiny", {"k": "5"})
