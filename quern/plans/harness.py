"""The workloads by name and preset: they are generated, run, timed, compared with an independent plan, and reported as result rows.

Variants have the names that the analyses know. ``cpu`` is the plan that all others are compared with: the array programs of ``operators.plain``, the blocks of
``operators.blocks``, or forests; ``gpu`` and its relatives are the plans of column expressions and rounds of joins. ``cpu`` itself is compared with ``gpu``.
"""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.scalars import horner
from quern.operators import evaluators as ev
from quern.operators import graph as go
from quern.operators import plain
from quern.plans.validate import validate
from quern.sources import entities as en
from quern.sources import graphs as gr

# Sizes of the presets.
PRESETS = {
    "foundation_smoke": {"tiny": {"values": 1024}, "small": {"values": 1_000_000}, "medium": {"values": 5_000_000}, "large": {"values": 20_000_000}},
    "polynomial_batch": {"tiny": {"values": 1024}, "small": {"values": 250_000}, "medium": {"values": 1_000_000}, "large": {"values": 5_000_000}},
    "cost_matrix": {p: {"tasks": n, "resources": n} for p, n in (("tiny", 64), ("small", 512), ("medium", 2048), ("large", 4096))},
    "spatial_events": {p: {"tracks": a, "zones": b} for p, a, b in (("tiny", 64, 32), ("small", 512, 256), ("medium", 4096, 512), ("large", 8192, 1024))},
    "graph_bfs": {
        p: {"graph": "layered", "chain_nodes": c, "grid_width": g, "grid_height": g, "layers": a, "nodes_per_layer": b, "fanout": k, "random_nodes": n, "random_out_degree": d, "seed": 0xC001CAFE, "source": 0}
        for p, c, g, a, b, k, n, d in (("tiny", 32, 8, 6, 16, 4, 128, 4), ("small", 8192, 128, 32, 512, 8, 32768, 8), ("medium", 65536, 512, 64, 4096, 8, 262144, 8), ("large", 262144, 1024, 96, 8192, 8, 1048576, 8))
    },
    "graph_connected_components": {
        p: {"graph": "random_clusters", "components": c, "component_size": s, "grid_width": g, "grid_height": g, "random_out_degree": d, "seed": 0xC0FFEE}
        for p, c, s, g, d in (("tiny", 4, 32, 8, 3), ("small", 64, 512, 32, 4), ("medium", 128, 2048, 64, 4), ("large", 256, 4096, 96, 4))
    },
    "graph_weighted_relaxation": {
        p: {"graph": "layered", "chain_nodes": c, "grid_width": g, "grid_height": g, "layers": a, "nodes_per_layer": b, "fanout": k, "random_nodes": n, "random_out_degree": 8, "seed": 0xA11CE, "source": 0, "delta": 16}
        for p, c, g, a, b, k, n in (("tiny", 256, 16, 8, 64, 4, 1024), ("small", 4096, 64, 32, 512, 6, 16384), ("medium", 16384, 256, 64, 4096, 8, 262144), ("large", 65536, 512, 96, 8192, 8, 1048576))
    },
    "constraint_network": {p: {"tasks": t, "resources": r, "candidates": c} for p, t, r, c in (("tiny", 64, 32, 4096), ("small", 512, 256, 262_144), ("medium", 2048, 1024, 1 << 20), ("large", 8192, 2048, 1 << 22))},
    "combination_finder": {p: {"items": n, "k": 3} for p, n in (("tiny", 64), ("small", 192), ("medium", 384), ("large", 768))},
    "assignment_preprocessing": {p: {"tasks": t, "resources": r, "top_k": k} for p, t, r, k in (("tiny", 64, 128, 4), ("small", 512, 1024, 8), ("medium", 2048, 2048, 8), ("large", 4096, 4096, 8))},
    "local_search_moves": {p: {"tasks": t, "resources": r, "moves": m} for p, t, r, m in (("tiny", 128, 256, 4096), ("small", 512, 1024, 65536), ("medium", 2048, 2048, 1 << 20), ("large", 4096, 4096, 1 << 22))},
    "scenario_simulation": {p: {"tasks": t, "resources": r, "scenarios": s} for p, t, r, s in (("tiny", 32, 16, 4096), ("small", 64, 32, 65536), ("medium", 128, 64, 1 << 20), ("large", 256, 128, 1 << 22))},
}
WORKLOADS = list(PRESETS)


@dataclass
class Config:
    benchmark: str = "all"
    preset: str = "tiny"
    repeat: int = 1
    warmup: int = 0
    validate: bool = True
    output: str | None = None
    verbose: bool = False
    params: dict[str, str] = field(default_factory=dict)


def sizes(benchmark: str, preset: str, params: dict[str, str] | None = None) -> dict:
    """The preset's sizes with the caller's own; names it does not have are ignored, as ``sweep_label`` is."""
    if benchmark not in PRESETS:
        raise ValueError(f"unknown benchmark: {benchmark}")
    if preset not in PRESETS[benchmark]:
        raise ValueError(f"unknown preset: {preset}")
    out = dict(PRESETS[benchmark][preset])
    for k, v in (params or {}).items():
        if k in out:
            out[k] = v if isinstance(out[k], str) else int(v, 0)
            if not isinstance(out[k], str) and out[k] < 0:
                raise ValueError(f"{k} must not be negative")
    if benchmark == "combination_finder" and out["k"] not in (2, 3, 4):
        raise ValueError("k must be 2, 3 or 4")
    if benchmark == "assignment_preprocessing":
        out["top_k"] = min(out["top_k"], out["resources"])
    if benchmark == "graph_weighted_relaxation" and out["delta"] <= 0:
        raise ValueError("delta must be positive")
    return out


def graph_parameters(s: dict) -> tuple[str, dict]:
    """The kind of a workload's graph and its parameters, by the names that ``sources.graphs`` has."""
    kind = s["graph"]
    given = {
        "nodes": s.get("chain_nodes") if kind == "chain" else s.get("random_nodes"), "width": s.get("nodes_per_layer") if kind == "layered" else s.get("grid_width"), "height": s.get("grid_height"),
        "layers": s.get("layers"), "fanout": s.get("fanout"), "degree": s.get("random_out_degree"), "seed": s.get("seed"), "components": s.get("components"), "size": s.get("component_size"),
    }
    if "components" in s:
        kind = {"random": "random_clusters", "chain": "chain_components", "grid": "grid_components"}.get(kind, kind)
    return kind, given


def make_graph(spark: SparkSession, s: dict) -> tuple[DataFrame, int]:
    kind, given = graph_parameters(s)
    return gr.make(spark, kind, **given)


def _entities(spark: SparkSession, name: str, s: dict) -> tuple:
    n = lambda k: en.numbered(spark, s[k])
    if name == "cost_matrix":
        return en.cost_tasks(n("tasks")), en.cost_resources(n("resources"))
    if name == "spatial_events":
        return en.tracks(n("tracks")), en.zones(n("zones"))
    if name == "constraint_network":
        return en.constraint_candidates(n("candidates"), s["tasks"], s["resources"]), en.constraint_tasks(n("tasks")), en.constraint_resources(n("resources"))
    if name == "assignment_preprocessing":
        return en.assignment_tasks(n("tasks")), en.assignment_resources(n("resources"))
    if name == "local_search_moves":
        return en.search_moves(n("moves"), s["tasks"], s["resources"]), en.search_tasks(n("tasks"), s["resources"]), en.search_resources(n("resources"))
    plan = en.base_plan(en.scenario_tasks(n("tasks")), en.scenario_resources(n("resources")))
    return en.scenarios(n("scenarios"), s["tasks"], s["resources"]), plan


def variants(spark: SparkSession, name: str, s: dict) -> tuple[dict, callable, int, dict]:
    """Plans of a workload by variant, each giving comparable rows; a function that sums rows up; the number of its units; and how its graph's plans ran, by variant."""
    runs: dict[str, go.Run] = {}
    if name == "foundation_smoke":
        ids = lambda: en.numbered(spark, s["values"])
        return {"cpu": lambda: plain.smoke(ids()), "gpu": lambda: en.smoke_values(ids())}, lambda d: d.agg(F.count("*").alias("n"), F.sum("y").alias("checksum")), s["values"], runs
    if name == "polynomial_batch":
        c = en.polynomial_coefficients()
        x = lambda: en.polynomial_domain(en.numbered(spark, s["values"]))
        folded = lambda: x().select("i", horner(F.col("x"), c).alias("y"))
        array = F.array(*[F.lit(v) for v in reversed(c)])
        looped = lambda: x().select("i", F.aggregate(array, F.lit(0.0), lambda a, k: a * F.col("x") + k).alias("y"))
        return {"cpu": looped, "gpu": folded}, lambda d: d.agg(F.count("*").alias("n"), F.sum("y").alias("checksum")), s["values"], runs
    if name == "combination_finder":
        items = lambda: en.items(en.numbered(spark, s["items"]))
        joined = lambda: ev.combination_summary(ev.joined_combinations(items(), s["k"]))
        return {"cpu": lambda: ev.combination_totals(items(), s["k"]), "gpu": joined}, lambda d: d, ev.combinations_count(s["items"], s["k"]), runs
    if name.startswith("graph_"):
        edges, n = make_graph(spark, s)
        nodes = spark.range(n).select(F.col("id").alias("node"))
        kind, given = graph_parameters(s)
        limit = go.guard(gr.NAMES.get(kind, kind), n, **{k: v for k, v in given.items() if k != "nodes"})

        def ran(variant: str) -> go.Run:
            runs[variant] = go.Run()
            return runs[variant]

        def noted(variant: str, found: tuple[DataFrame, go.Run]) -> DataFrame:
            runs[variant] = found[1]
            return found[0]

        if name == "graph_bfs":
            if not 0 <= s["source"] < n:
                raise ValueError("the source is no node of the graph")
            edges = go.written(edges, "edges")
            rounds = lambda: go.bfs_rounds(edges, s["source"], nodes, n + 1, ran("gpu"))
            return {"cpu": lambda: go.bfs(edges, s["source"], nodes, ran("cpu")), "gpu": rounds}, lambda d: go.bfs_profile(d, edges), n, runs
        if name == "graph_connected_components":
            edges = go.written(edges, "edges")
            spread = lambda: noted("gpu", go.propagated_components(edges, nodes, limit))
            stars = lambda: go.components(edges, nodes, ran("gpu-non-naive"))
            return {"cpu": lambda: go.forest_components(edges, nodes), "gpu": spread, "gpu-non-naive": stars}, go.component_stats, n, runs
        edges = go.written(gr.weighted(edges), "edges")

        def paths(variant: str, method: str) -> callable:
            return lambda: go.with_unreached(noted(variant, go.shortest_paths(edges, s["source"], method, s["delta"])), nodes)

        methods = {"cpu": "blocks", "gpu": "global", "gpu-frontier": "frontier", "gpu-delta-stepping": "delta", "gpu-delta-light-heavy": "light_heavy"}
        return {v: paths(v, m) for v, m in methods.items()}, go.path_stats, n, runs
    e = _entities(spark, name, s)
    if name == "cost_matrix":
        return {"cpu": lambda: plain.costs(*e), "gpu": lambda: ev.cost_pairs(*e)}, ev.cost_summary, s["tasks"] * s["resources"], runs
    if name == "spatial_events":
        pairs = s["tracks"] * s["zones"]
        return {"cpu": lambda: ev.spatial_matrix(*e).where("code > 0"), "gpu": lambda: ev.spatial_events(*e)}, lambda d: ev.spatial_summary(d, pairs), pairs, runs
    if name == "constraint_network":
        return {"cpu": lambda: plain.candidates(*e), "gpu": lambda: ev.evaluate_candidates(*e)}, ev.candidate_summary, s["candidates"], runs
    if name == "assignment_preprocessing":
        whole = lambda: ev.padded(ev.top_assignments(ev.assignment_pairs(*e).where("mask = 0"), s["top_k"]), e[0], s["top_k"])
        by_skill = lambda: ev.padded(ev.top_assignments(ev.feasible_assignments(*e), s["top_k"]), e[0], s["top_k"])
        pairs = s["tasks"] * s["resources"]

        def summed(d: DataFrame) -> DataFrame:
            return ev.assignment_summary(d.where("resource_id >= 0"), pairs).crossJoin(F.broadcast(ev.assignment_reasons(ev.assignment_pairs(*e))))

        return {"cpu": whole, "gpu": by_skill}, summed, pairs, runs
    if name == "local_search_moves":
        return {"cpu": lambda: plain.moves(*e), "gpu": lambda: ev.evaluate_moves(*e)}, ev.move_summary, s["moves"], runs
    return {"cpu": lambda: ev.evaluate_scenarios(*e), "gpu": lambda: ev.folded_scenarios(*e)}, ev.scenario_summary, s["scenarios"], runs


# Metadata names that analyses read, by the columns of the summaries.
METADATA = {
    "constraint_network": {n: f"{n}_violations" for n in ev.CONSTRAINTS} | {"zone": "forbidden_zone_violations"}, "combination_finder": {n: f"{n}_violations" for n in ev.COMBINATIONS},
    "local_search_moves": {n: f"{n}_violations" for n in ev.MOVES}, "scenario_simulation": {"feasible_count": "feasible_scenarios", "infeasible_count": "infeasible_scenarios", "robustness": "robustness_score"},
    "assignment_preprocessing": {n: f"{n}_violations" for n in ev.ASSIGNMENT} | {"feasible": "feasible_pair_count", "selected": "selected_candidate_count", "tasks_with_any": "tasks_with_any_candidate", "reduction_ratio": "candidate_reduction_ratio"},
    "graph_connected_components": {"largest_component": "largest_component_size"},
}


def device(spark: SparkSession) -> str:
    return f"Spark {spark.version}, {spark.sparkContext.defaultParallelism} cores, {os.cpu_count()} on the driver"


def run_one(spark: SparkSession, name: str, config: Config) -> list[dict]:
    """A result row for each variant, compared with a plan that shares no formula or no order of work with it."""
    s = sizes(name, config.preset, config.params)
    plans, summed, units, runs = variants(spark, name, s)
    rows, names, given = [], METADATA.get(name, {}), {k: v for k, v in s.items() if isinstance(v, int)} | {"units": units}
    about = {}
    if name == "combination_finder":
        given["combinations"] = units
    if "graph" in s:
        edges, n = make_graph(spark, s)
        degree = go.degree_stats(edges.select("src", "dst").distinct(), spark.range(n).select(F.col("id").alias("node"))).first()
        kind, parameters = graph_parameters(s)
        given |= {"nodes": n, "edges": degree["edge_count"]}
        about = {"graph_kind": s["graph"], "shape": gr.shape(kind, **parameters), "mean_out_degree": f"{degree['mean_out_degree']:.6f}"}
    took, found = {}, {}
    for variant, plan in plans.items():
        for _ in range(config.warmup):
            plan().write.format("noop").mode("overwrite").save()
        t = time.perf_counter()
        for k in range(config.repeat):  # the last run is kept to be compared
            if k < config.repeat - 1:
                plan().write.format("noop").mode("overwrite").save()
            else:
                found[variant] = go.written(plan(), "result")
        took[variant] = (time.perf_counter() - t) * 1000
    for variant, result in found.items():
        check = validate(name, result, found["gpu" if variant == "cpu" else "cpu"]).first()
        stats = summed(result)
        facts = {} if "code" in stats.columns else {names.get(k, k): str(v) for k, v in stats.first().asDict().items() if v is not None}
        if "mean_cost_milli" in facts:
            facts["mean_selected_cost"] = f"{float(facts['mean_cost_milli']) / 1000:.6f}"
        ran = go.described(runs[variant]) if variant in runs else {}
        wrong = check["mismatches"] + check["missing"]
        rows.append({
            "benchmark": name, "variant": variant, "preset": config.params.get("sweep_label", config.preset), "repeat": config.repeat, "warmup": config.warmup,
            "input_size": given, "total_ms": took[variant], "h2d_ms": 0.0, "kernel_ms": took[variant], "d2h_ms": 0.0, "correct": bool(check["correct"]),
            "device": device(spark), "notes": "", "metadata": about | ran | facts | {"mismatch_count": str(wrong), "max_abs_error": f"{check['max_abs_error']:.6f}"},
        })
    return rows


def run(spark: SparkSession, config: Config) -> list[dict]:
    """Result rows of one workload, or of all in their order."""
    names = WORKLOADS if config.benchmark == "all" else [config.benchmark]
    if names[0] not in PRESETS:
        raise ValueError(f"unknown benchmark: {config.benchmark}")
    return [r for n in names for r in run_one(spark, n, config)]


def run_presets(spark: SparkSession, presets: list[str], config: Config) -> list[dict]:
    return [r for p in presets for r in run(spark, Config(**(vars(config) | {"preset": p})))]


def sweep(spark: SparkSession, benchmark: str, points: list[dict[str, str]], config: Config) -> list[dict]:
    """A workload at several points; each point's ``sweep_label`` names it in the rows."""
    return [r for p in points for r in run(spark, Config(**(vars(config) | {"benchmark": benchmark, "params": config.params | p})))]


def _points(label: str, names: tuple[str, ...], rows: list[tuple], **fixed: str) -> list[dict[str, str]]:
    return [{"sweep_label": label.format(*r)} | fixed | dict(zip(names, map(str, r))) for r in rows]


_LAYERED = ("layers", "nodes_per_layer", "fanout")
# Sweeps by label and sizes.
SWEEPS = {
    "constraint_network": _points("cn_{2}", ("tasks", "resources", "candidates"), [(64, 32, 4096), (128, 64, 16384), (256, 128, 65536), (384, 192, 131072), (512, 256, 262144), (1024, 512, 524288), (2048, 1024, 1048576), (4096, 1024, 2097152), (8192, 2048, 4194304)]),
    "combination_finder": _points("comb_{0}_choose_{1}", ("items", "k"), [(64, 3), (128, 3), (192, 3), (256, 3), (384, 3), (128, 4), (512, 3), (192, 4)]),
    "assignment_preprocessing": _points("ap_{0}x{1}", ("tasks", "resources", "top_k"), [(128, 256, 4), (512, 512, 8), (1024, 1024, 8), (2048, 2048, 8), (4096, 2048, 8), (4096, 4096, 8), (8192, 4096, 8)]),
    "local_search_moves": _points("ls_{2}", ("tasks", "resources", "moves"), [(128, 256, 4096), (256, 512, 16384), (512, 1024, 65536), (1024, 1024, 262144), (2048, 2048, 1048576), (4096, 4096, 4194304)]),
    "scenario_simulation": _points("sc_{2}", ("tasks", "resources", "scenarios"), [(32, 16, 4096), (32, 16, 16384), (64, 32, 65536), (64, 32, 262144), (128, 64, 1048576), (128, 64, 4194304)]),
    "graph_bfs": [
        *_points("chain_{0}", ("chain_nodes",), [(256,), (1024,), (4096,), (8192,), (16384,)], graph="chain"), *_points("grid_{0}x{1}", ("grid_width", "grid_height"), [(16, 16), (64, 64), (128, 128), (512, 512)], graph="grid"),
        *_points("layered_{0}x{1}", _LAYERED, [(6, 16, 4), (8, 64, 4), (16, 256, 8), (32, 512, 8), (64, 4096, 8), (96, 8192, 8)], graph="layered"),
        *_points("random_{0}", ("random_nodes",), [(256,), (4096,), (16384,), (65536,), (262144,), (1048576,)], graph="random", random_out_degree="8"),
    ],
    "graph_connected_components": [
        *_points("chains_{0}x{1}", ("components", "component_size"), [(8, 64), (16, 128), (32, 256), (64, 512)], graph="chains"),
        *_points("grids_{0}x{1}x{2}", ("components", "grid_width", "grid_height"), [(4, 16, 16), (8, 32, 32), (16, 64, 64), (24, 96, 96)], graph="grid_components"),
        *_points("clusters_{0}x{1}", ("components", "component_size"), [(8, 128), (16, 256), (32, 512), (64, 1024)], graph="random_clusters"),
        *_points("mixed_{0}x{1}", ("components", "component_size"), [(8, 128), (16, 256), (32, 512), (64, 1024)], graph="mixed"),
    ],
    "graph_weighted_relaxation": [
        *_points("chain_{0}", ("chain_nodes",), [(256,), (1024,), (4096,)], graph="chain"), *_points("grid_{0}x{1}", ("grid_width", "grid_height"), [(16, 16), (64, 64), (128, 128)], graph="grid"),
        *_points("layered_{0}x{1}", _LAYERED, [(8, 64, 4), (16, 256, 6), (32, 512, 6), (64, 2048, 8)], graph="layered"), *_points("random_{0}", ("random_nodes",), [(1024,), (16384,), (65536,)], graph="random"),
        *_points("random_{0}_delta{1}", ("random_nodes", "delta"), [(n, d) for n in (1024, 16384) for d in (4, 16, 64)], graph="random"),
    ],
}
