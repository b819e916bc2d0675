"""Analyses of result rows: times by variant, speedups, metrics of the runs, recommendations.

Every analysis takes rows as ``quern.sources.results.read_jsonl`` gives them and returns one row a sweep point. Points differ in their key and in which rows
count: most take the mean of the correct rows, some the last row. Times are those of one repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalars import label_delta, to_double, to_int

C = F.col
# Variants, graph kinds in their order, and other names of kinds.
BFS_KINDS = ["chain", "grid", "layered", "random"]
CC_KINDS = ["chain", "grid", "random", "mixed"]
CC_ALIASES = {"chains": "chain", "chain_components": "chain", "grids": "grid", "grid_components": "grid", "random_sparse": "random", "random_clusters": "random"}
SSSP_VARIANTS = {"gpu": "global", "gpu-frontier": "frontier", "gpu-delta-stepping": "delta", "gpu-delta-light-heavy": "delta_light_heavy"}
BACKENDS = {
    "cpu": "cpu_ms_per_run", "gpu-global": "gpu_global_ms_per_run", "gpu-frontier": "gpu_frontier_ms_per_run", "gpu-delta-stepping": "gpu_delta_ms_per_run",
    "gpu-delta-light-heavy": "gpu_delta_light_heavy_ms_per_run",
}
EXACT = ["frontier_level_count", "max_frontier_size", "mean_frontier_size", "reached_edge_visits", "max_frontier_edge_visits", "mean_frontier_edge_visits", "mean_reached_out_degree", "frontier_width_to_depth"]


def meta(name: str, rep: str = "") -> Column:
    return C(f"{rep}metadata")[name]


def number(x: Column) -> Column:
    return to_double(F.when(F.trim(x) != "", x))


def whole(x: Column) -> Column:
    """A whole number of a text, of one with decimals too."""
    return to_double(F.when(F.trim(x) != "", x)).cast("long")


def strict(x: Column) -> Column:
    return to_int(F.when(F.trim(x) != "", x))


def timed(rows: DataFrame, benchmark: str) -> DataFrame:
    """One benchmark's rows with ``ms``, the time of one repeat, and their sizes as columns are read by ``size``."""
    repeat = F.when(C("repeat") > 0, C("repeat")).otherwise(1)
    return rows.where(C("benchmark") == benchmark).withColumns({"ms": C("total_ms") / repeat, "kernel": C("kernel_ms") / repeat, "label": C("preset")})


def size(name: str) -> Column:
    return F.coalesce(C("input_size")[name], F.lit(0)).alias(name)


def _rows(variant: str, correct: bool = True) -> Column:
    return (C("variant") == variant) & C("correct") if correct else C("variant") == variant


def mean(variant: str) -> Column:
    return F.avg(F.when(_rows(variant), C("ms")))


def chosen(variant: str, last: bool = False, correct: bool = True) -> Column:
    """The first or last row of a variant, as a struct."""
    return (F.max_by if last else F.min_by)(F.struct("metadata", "preset", "ms", "kernel", "correct"), F.when(_rows(variant, correct), C("place")))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def position(kind: Column, kinds: list[str]) -> Column:
    at = F.array_position(F.array(*map(F.lit, kinds)), kind)
    return F.when(at > 0, at).otherwise(len(kinds) + 1)


def bfs(rows: DataFrame) -> DataFrame:
    """By kind, nodes, edges and shape: mean times of correct rows, speedup, and eight measures of the frontier, exact or estimated from older ones."""
    kind = F.when(meta("graph_kind") == "random_sparse", "random").otherwise(meta("graph_kind")).alias("graph_kind")
    t = timed(rows, "graph_bfs").where("correct").where(C("variant").isin("cpu", "gpu"))
    t = t.select("*", kind, size("nodes"), size("edges"), F.coalesce(meta("shape"), F.lit("")).alias("shape")).where(C("graph_kind").isin(BFS_KINDS))
    g = t.groupBy("graph_kind", "nodes", "edges", "shape").agg(
        mean("cpu").alias("cpu_ms_per_run"), mean("gpu").alias("gpu_ms_per_run"), F.coalesce(chosen("cpu"), chosen("gpu")).alias("rep"), F.count_if(_rows("cpu")).alias("cpu_rows"), F.count_if(_rows("gpu")).alias("gpu_rows")
    )
    m = {n: number(meta(n, "rep.")) for n in EXACT}
    far, reached = whole(meta("max_distance", "rep.")), whole(meta("reached_count", "rep."))
    levels = F.coalesce(m["frontier_level_count"], F.when(far >= 0, far + 1.0))
    degree = F.coalesce(m["mean_reached_out_degree"], number(meta("mean_out_degree", "rep.")), ratio(C("edges").cast("double"), C("nodes")))
    visits = F.coalesce(m["reached_edge_visits"], reached * degree)
    width = F.coalesce(m["mean_frontier_size"], ratio(reached.cast("double"), levels))
    work = F.coalesce(m["mean_frontier_edge_visits"], ratio(visits, levels))
    exact = F.coalesce(F.exists(F.array(*[meta(n, "rep.") for n in EXACT]), lambda x: x.isNotNull() & (x != "")), F.lit(False))
    source = F.when(exact, "exact").when(work.isNotNull() | width.isNotNull(), "fallback_estimate").otherwise("unavailable")
    derived = {
        "frontier_level_count": levels, "max_frontier_size": m["max_frontier_size"], "mean_frontier_size": width, "reached_edge_visits": visits, "max_frontier_edge_visits": m["max_frontier_edge_visits"],
        "mean_frontier_edge_visits": work, "mean_reached_out_degree": degree, "frontier_width_to_depth": F.coalesce(m["frontier_width_to_depth"], ratio(width, levels)),
    }
    out = g.select(
        "graph_kind", "nodes", "edges", "shape", C("rep.preset").alias("preset"), "cpu_ms_per_run", "gpu_ms_per_run", ratio(C("cpu_ms_per_run"), C("gpu_ms_per_run")).alias("speedup_cpu_over_gpu"),
        far.alias("max_distance"), reached.alias("reached_count"), *[c.alias(n) for n, c in derived.items()], source.alias("frontier_metric_source"), "cpu_rows", "gpu_rows",
    )
    return out.orderBy(position(C("graph_kind"), BFS_KINDS), "nodes", "edges", "shape")


def bfs_diagnosis(summary: DataFrame) -> list[str]:
    """What a BFS analysis lacks, in words; one small aggregate comes to the driver."""
    f = summary.agg(
        F.count("*").alias("points"), F.count_if(C("cpu_ms_per_run").isNotNull() & C("gpu_ms_per_run").isNotNull()).alias("pairs"), F.count_if(C("frontier_metric_source") == "exact").alias("exact"),
        F.count_if(C("frontier_metric_source") == "fallback_estimate").alias("estimated"), F.count("mean_frontier_edge_visits").alias("work"), F.count("max_frontier_size").alias("width"), F.collect_set("graph_kind").alias("kinds"),
    ).first()
    if not f["points"]:
        return ["No correct traversal rows: all plots will be empty."]
    out = [f"{f['pairs']} points have both variants." if f["pairs"] else "No point has both variants: there are no speedups."]
    out.append("Exact frontier measures exist." if f["exact"] else "Exact frontier measures are missing.")
    if f["estimated"]:
        out.append(f"Frontier measures are estimated for {f['estimated']} points.")
    out.append("Work per level is known." if f["work"] else "Work per level is unknown.")
    if not f["width"]:
        out.append("The largest frontier is unknown and cannot be estimated.")
    kinds = [k for k in BFS_KINDS if k in f["kinds"]]
    out.append("Graph kinds: " + ", ".join(kinds))
    if kinds == ["layered"]:
        out.append("Only layered graphs: shapes cannot be compared.")
    return out


def components(rows: DataFrame) -> DataFrame:
    """By kind, label, nodes and edges: mean times of correct rows, speedups of both variants and between them, rounds and edges times rounds."""
    names = {"cpu": "cpu", "gpu": "gpu_naive", "gpu-non-naive": "gpu_non_naive"}
    alias = F.create_map(*[F.lit(x) for kv in CC_ALIASES.items() for x in kv])
    kind = F.coalesce(alias[meta("graph_kind")], meta("graph_kind"), F.lit("")).alias("graph_kind")
    t = timed(rows, "graph_connected_components").where(C("variant").isin(*names)).select("*", kind, size("nodes"), size("edges"))
    means = [mean(v).alias(f"{n}_ms_per_run") for v, n in names.items()]
    picks = [chosen(v).alias(n) for v, n in names.items()]
    anyone = [chosen(v, correct=False) for v in names]
    counts = [F.count_if(_rows(v, False)).alias(f"{n}_rows") for v, n in names.items()] + [F.count_if(_rows(v)).alias(f"correct_{n}_rows") for v, n in names.items()]
    g = t.groupBy("graph_kind", "label", "nodes", "edges").agg(*means, *picks, F.coalesce(*anyone).alias("other"), *counts)
    g = g.withColumn("rep", F.coalesce("gpu_non_naive", "gpu_naive", "cpu", "other"))
    rounds = {n: strict(C(n)["metadata"]["iterations"]) for n in ("gpu_naive", "gpu_non_naive")}
    per = {n: [rounds[n].alias(f"{n}_iterations"), (F.lower(C(n)["metadata"]["converged"]) == "true").alias(f"{n}_converged"), (rounds[n] * C("edges")).alias(f"{n}_edge_iterations")] for n in rounds}
    cpu, naive, other = (C(f"{n}_ms_per_run") for n in names.values())
    out = g.select(
        "graph_kind", "label", "nodes", "edges", C("rep")["metadata"]["shape"].alias("shape"), *[f"{n}_ms_per_run" for n in names.values()], ratio(cpu, naive).alias("speedup_cpu_over_gpu_naive"),
        ratio(cpu, other).alias("speedup_cpu_over_gpu_non_naive"), ratio(naive, other).alias("gpu_naive_to_non_naive_speedup"), *per["gpu_naive"], *per["gpu_non_naive"],
        strict(C("rep")["metadata"]["component_count"]).alias("component_count"), strict(C("rep")["metadata"]["largest_component_size"]).alias("largest_component_size"),
        number(C("rep")["metadata"]["mean_out_degree"]).alias("mean_out_degree"), *[f"{p}{n}_rows" for p in ("", "correct_") for n in names.values()],
    )
    return out.orderBy(position(C("graph_kind"), CC_KINDS), "nodes", "label")


def paths(rows: DataFrame) -> DataFrame:
    """By kind, label, nodes and edges: mean times of correct rows, speedups, rounds, visits and work of each variant, and its gain over the global one."""
    kind = F.when(meta("graph_kind") == "random_sparse", "random").otherwise(meta("graph_kind")).alias("graph_kind")
    t = timed(rows, "graph_weighted_relaxation").select("*", kind, size("nodes"), size("edges")).where(C("graph_kind").isin(BFS_KINDS))
    variants = {"cpu": "cpu"} | {v: f"gpu_{s}" for v, s in SSSP_VARIANTS.items()}
    agg = [mean(v).alias(f"{n}_ms_per_run") for v, n in variants.items()] + [F.coalesce(chosen(v), chosen(v, correct=False)).alias(n) for v, n in variants.items()]
    agg += [F.count_if(_rows(v, c)).alias(f"{'correct_' if c else ''}{n}_rows") for v, n in variants.items() for c in (False, True)]
    g = t.groupBy("graph_kind", "label", "nodes", "edges").agg(*agg).withColumn("rep", F.coalesce(*variants.values())).where("rep is not null")
    degree = number(C("rep")["metadata"]["mean_out_degree"])
    out = ["graph_kind", "label", "nodes", "edges", C("rep")["metadata"]["shape"].alias("shape"), "cpu_ms_per_run", *[strict(C("rep")["metadata"][n]).alias(n) for n in ("reached_count", "max_finite_distance")], degree.alias("mean_out_degree")]
    for s in SSSP_VARIANTS.values():
        n, m = f"gpu_{s}", C(f"gpu_{s}")["metadata"]
        visits = strict(m["active_frontier_node_visits"])
        out += [
            f"{n}_ms_per_run", ratio(C("cpu_ms_per_run"), C(f"{n}_ms_per_run")).alias(f"speedup_cpu_over_{n}"), strict(m["iterations"]).alias(f"{n}_iterations"), (F.lower(m["converged"]) == "true").alias(f"{n}_converged"),
            strict(m["edge_iterations"]).alias(f"{n}_edge_iterations"), visits.alias(f"{n}_active_node_visits"), (visits * degree).alias(f"{n}_edge_work_estimate"), strict(m["max_frontier_size"]).alias(f"{n}_max_frontier_size"),
            strict(m["mismatch_count"]).alias(f"{s}_mismatch_count"),
        ]
        if s != "global":
            out.append(ratio(C("gpu_global_ms_per_run"), C(f"{n}_ms_per_run")).alias(f"gpu_global_to_{s}_speedup"))
    out += [f"{p}{n}_rows" for n in variants.values() for p in ("", "correct_")]
    return g.select(*out).orderBy(position(C("graph_kind"), BFS_KINDS), "nodes", "label")


def _two(rows: DataFrame, benchmark: str, key: dict[str, str], last: bool, correct: bool = True) -> DataFrame:
    """Times of cpu and gpu by key, the last row of each or the mean of the correct ones, with the row that stands for the point."""
    t = timed(rows, benchmark).select("*", *[size(n).alias(a) for a, n in key.items()])
    one = [chosen(v, last, correct).alias(v) for v in ("cpu", "gpu")]
    rest = [F.coalesce(chosen("cpu", correct=False), chosen("gpu", correct=False)).alias("other"), F.count_if(_rows("cpu")).alias("correct_cpu_rows"), F.count_if(_rows("gpu")).alias("correct_gpu_rows")]
    if last:
        g = t.where(C("variant").isin("cpu", "gpu")).groupBy("label", *key).agg(*one, *rest)
        g = g.withColumns({f"{v}_ms_per_run": C(v)["ms"] for v in ("cpu", "gpu")} | {"gpu_kernel_ms_per_run": C("gpu")["kernel"]})
        g = g.withColumn("rep", F.coalesce("gpu", "cpu")).where("rep is not null")
    else:
        phases = [F.avg(F.when(_rows("gpu"), C(c) / F.greatest(C("repeat"), F.lit(1)))).alias(f"mean_{c}") for c in ("h2d_ms", "kernel_ms", "d2h_ms")]
        g = t.where(C("variant").isin("cpu", "gpu")).groupBy("label", *key).agg(mean("cpu").alias("cpu_ms_per_run"), mean("gpu").alias("gpu_ms_per_run"), *one, *rest, *phases)
        g = g.withColumn("rep", F.coalesce("gpu", "cpu", "other"))
    return g.withColumn("speedup_cpu_over_gpu", ratio(C("cpu_ms_per_run"), C("gpu_ms_per_run")))


def _of(*names: str) -> list[Column]:
    return [strict(C("rep")["metadata"][n]).alias(n) for n in names]


TIMES = ["cpu_ms_per_run", "gpu_ms_per_run", "speedup_cpu_over_gpu"]
CN_REASONS = [f"{n}_violations" for n in ("skill", "capacity", "task_window", "resource_window", "distance", "forbidden_zone", "risk")]


def constraints(rows: DataFrame) -> DataFrame:
    g = _two(rows, "constraint_network", {"tasks": "tasks", "resources": "resources", "candidates": "candidates"}, last=False)
    out = g.select("label", "tasks", "resources", "candidates", *TIMES, "mean_h2d_ms", "mean_kernel_ms", "mean_d2h_ms", *_of("valid_count", "total_violations", *CN_REASONS), "correct_cpu_rows", "correct_gpu_rows")
    more = {"valid_ratio": ratio(C("valid_count"), C("candidates")), "violations_per_candidate": ratio(C("total_violations"), C("candidates"))}
    return out.withColumns(more).orderBy("candidates")


def constraint_diagnostics(rows: DataFrame) -> DataFrame:
    """Rates of each reason and of invalid candidates, phases of the times, and the reason that dominates the largest point."""
    s = constraints(rows)
    rates = {n.replace("_violations", "_rate"): ratio(C(n), C("candidates")) for n in CN_REASONS}
    return s.select("label", "candidates", (1 - C("valid_ratio")).alias("invalid_ratio"), *[c.alias(n) for n, c in rates.items()], "mean_h2d_ms", "mean_kernel_ms", "mean_d2h_ms").orderBy("candidates")


def dominant_reason(summary: DataFrame) -> DataFrame:
    """(label, reason, count): the commonest violation at the largest point; the one listed first wins ties."""
    each = summary.select("label", "candidates", F.posexplode(F.create_map(*[x for n in CN_REASONS for x in (F.lit(n), C(n))])).alias("at", "reason", "count"))
    return each.orderBy(F.desc("candidates"), F.desc("count"), "at").limit(1).select("label", "reason", "count")


def combinations(rows: DataFrame) -> DataFrame:
    g = _two(rows, "combination_finder", {"items": "items", "k": "k", "combinations": "combinations"}, last=False)
    m = C("rep")["metadata"]
    valid = F.coalesce(strict(m["valid_count"]), F.lit(0))
    out = g.select(
        "label", "items", "k", "combinations", *TIMES, valid.alias("valid_count"), F.coalesce(strict(m["invalid_count"]), F.greatest(F.lit(0), C("combinations") - valid)).alias("invalid_count"),
        F.coalesce(ratio(valid.cast("double"), C("combinations")), F.lit(0.0)).alias("valid_ratio"), *[F.coalesce(strict(m[n]), F.lit(0)).alias(n) for n in ("budget_violations", "risk_violations", "coverage_violations", "spread_violations", "best_score")],
    )
    return out.orderBy("combinations", "label")


def assignment(rows: DataFrame) -> DataFrame:
    """The last correct row of each variant stands for a point."""
    g = _two(rows, "assignment_preprocessing", {"tasks": "tasks", "resources": "resources", "top_k": "top_k"}, last=True)
    m = C("rep")["metadata"]
    reasons = [F.coalesce(strict(m[f"{n}_violations"]), F.lit(0)).alias(f"{n}_violations") for n in ("skill", "capacity", "time", "distance", "zone", "risk")]
    counts = [F.coalesce(strict(m[n]), F.lit(0)).alias(n) for n in ("feasible_pair_count", "selected_candidate_count", "tasks_with_any_candidate")]
    out = g.select("label", "tasks", "resources", (C("tasks") * C("resources")).alias("pairs"), "top_k", *TIMES, "gpu_kernel_ms_per_run", *counts, number(m["candidate_reduction_ratio"]).alias("candidate_reduction_ratio"), number(m["mean_selected_cost"]).alias("mean_selected_cost"), *reasons)
    return out.orderBy("pairs", "top_k", "label")


def local_search(rows: DataFrame) -> DataFrame:
    """The last row of each variant stands for a point, correct or not; ratios, moves a millisecond and overhead besides."""
    g = _two(rows, "local_search_moves", {"tasks": "tasks", "resources": "resources", "moves": "moves"}, last=True, correct=False)
    m = C("rep")["metadata"]
    counts = [F.coalesce(strict(m[n]), F.lit(0)).alias(n) for n in ("valid_moves", "invalid_moves", "improving_moves", *[f"{x}_violations" for x in ("skill", "capacity", "distance", "risk", "no_change")])]
    out = g.select(
        "label", "tasks", "resources", "moves", *TIMES, "gpu_kernel_ms_per_run", *counts, F.coalesce(number(m["best_delta"]), F.lit(0.0)).alias("best_delta"),
        F.coalesce(C("cpu")["correct"], F.lit(False)).alias("cpu_correct"), F.coalesce(C("gpu")["correct"], F.lit(False)).alias("gpu_correct"),
    )
    more = {
        "valid_ratio": ratio(C("valid_moves"), C("moves")), "improving_ratio": ratio(C("improving_moves"), C("moves")), "cpu_moves_per_ms": ratio(C("moves"), C("cpu_ms_per_run")),
        "gpu_moves_per_ms": ratio(C("moves"), C("gpu_ms_per_run")), "gpu_overhead_ms": F.greatest(F.lit(0.0), C("gpu_ms_per_run") - C("gpu_kernel_ms_per_run")),
    }
    return out.withColumns(more).orderBy("moves")


def plateaus(summary: DataFrame) -> DataFrame:
    """``summary`` of local search with the throughput of the point before and whether it stopped growing (by a twentieth); sweeps are small."""
    before = F.lag("gpu_moves_per_ms").over(Window.partitionBy("tasks", "resources").orderBy("moves"))
    return summary.withColumn("before", before).withColumn("plateau", C("gpu_moves_per_ms") < 1.05 * C("before"))


def scenarios(rows: DataFrame) -> DataFrame:
    """The last row of each variant stands for a point; a speedup needs both correct."""
    g = _two(rows, "scenario_simulation", {"tasks": "tasks", "resources": "resources", "scenarios": "scenarios"}, last=True, correct=False)
    m = C("rep")["metadata"]
    good, bad = (F.coalesce(strict(m[f"{n}_scenarios"]), F.lit(0)) for n in ("feasible", "infeasible"))
    both = F.coalesce(C("cpu")["correct"] & C("gpu")["correct"], F.lit(False))
    out = g.select(
        "label", "tasks", "resources", "scenarios", "cpu_ms_per_run", "gpu_ms_per_run", "gpu_kernel_ms_per_run", F.when(both, C("speedup_cpu_over_gpu")).alias("speedup_cpu_over_gpu"),
        ratio(good.cast("double"), good + bad).alias("feasible_ratio"), ratio(bad.cast("double"), good + bad).alias("infeasible_ratio"), *_of(*[f"{n}_scenarios" for n in ("failure", "capacity", "risk", "delay")]),
        *[number(m[f"{n}_score"]).alias(f"{n}_score") for n in ("mean", "best", "worst", "robustness")], C("cpu")["correct"].alias("correct_cpu"), C("gpu")["correct"].alias("correct_gpu"),
    )
    return out.withColumn("one_sided", C("feasible_ratio").isin(0.0, 1.0)).orderBy("scenarios")


def recommended(summary: DataFrame) -> DataFrame:
    """The fastest backend of each point of ``paths`` (the one listed first on ties), its time, and why."""
    each = F.array(*[F.when(C(c).isNotNull(), F.struct(C(c).alias("ms"), F.lit(i).alias("at"), F.lit(n).alias("name"))) for i, (n, c) in enumerate(BACKENDS.items())])
    out = summary.withColumn("_b", F.array_min(F.array_compact(each)))
    best, kind = F.coalesce(C("_b")["name"], F.lit("n/a")), C("graph_kind")
    reason = (
        F.when((best == "cpu") & kind.isin("chain", "grid"), "CPU: the graph is deep, so relaxation needs many rounds")
        .when((best == "cpu") & (C("gpu_global_iterations") > 32), "CPU: relaxation needed many rounds")
        .when(best == "cpu", "CPU: the graph is too small to pay for the overhead")
        .when(best == "gpu-global", "global scan: few rounds over many edges")
        .when((best == "gpu-frontier") & (C("gpu_frontier_max_frontier_size") > C("nodes")), "frontier: less work despite repeated entries")
        .when(best == "gpu-frontier", "frontier: the active set stayed small")
        .when(best == "gpu-delta-stepping", "delta stepping: buckets saved relaxations")
        .when(best == "gpu-delta-light-heavy", "light and heavy edges: closing buckets over light edges saved relaxations")
        .otherwise("no time is known")
    )
    return out.select("graph_kind", "label", "nodes", "edges", *BACKENDS.values(), best.alias("best_backend"), C("_b")["ms"].alias("best_ms_per_run"), reason.alias("reason"))


def crossovers(summary: DataFrame, speedups: list[str]) -> DataFrame:
    """(graph_kind, variant, label, nodes, speedup): the smallest graph of each kind where a variant beats the CPU."""
    each = summary.select("graph_kind", "label", "nodes", F.explode(F.array(*[F.struct(F.lit(s).alias("variant"), C(s).alias("speedup")) for s in speedups])).alias("v")).select("graph_kind", "label", "nodes", "v.*")
    w = Window.partitionBy("graph_kind", "variant").orderBy("nodes", "label")
    return each.where("speedup > 1").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def delta_tuning(rows: DataFrame, correct_only: bool = False) -> DataFrame:
    """(case, delta, variant, ms_per_run, iterations, correct) of rows whose label names a delta."""
    t = timed(rows, "graph_weighted_relaxation").withColumn("d", label_delta(C("preset"))).where("d.delta is not null")
    out = t.select("place", "d.case", "d.delta", "variant", C("ms").alias("ms_per_run"), strict(meta("iterations")).alias("iterations"), "correct")
    return (out.where("correct") if correct_only else out).orderBy("case", "delta", "variant", "place").drop("place")


def compared(rows: DataFrame) -> DataFrame:
    """(benchmark, preset, cpu_ms, gpu_ms, speedup) of the last rows of both variants; whole times, not those of a repeat."""
    last = [F.max_by("total_ms", F.when(C("variant") == v, C("place"))).alias(f"{v}_ms") for v in ("cpu", "gpu")]
    g = rows.groupBy("benchmark", "preset").agg(*last).where("cpu_ms is not null and gpu_ms > 0")
    return g.withColumn("speedup", C("cpu_ms") / C("gpu_ms")).orderBy("benchmark", "preset")


def report(rows: DataFrame) -> DataFrame:
    return rows.orderBy("place").select("benchmark", "variant", "preset", "total_ms", "kernel_ms", "correct", "device")


def scaling(summary: DataFrame, by: str = "nodes") -> DataFrame:
    """A summary's times and speedups in long form, (kind, size, series, value), as plots take them."""
    names = [c for c in summary.columns if c.endswith("_ms_per_run") or c.startswith("speedup") or c.endswith("_iterations")]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("series"), C(n).cast("double").alias("value")) for n in names])).alias("s")
    kind = C("graph_kind") if "graph_kind" in summary.columns else F.lit("")
    return summary.select(kind.alias("kind"), C(by).alias("size"), each).select("kind", "size", "s.*").where("value is not null")


#: The analysis of each workload that has one.
ANALYSES = {
    "graph_bfs": bfs, "graph_connected_components": components, "graph_weighted_relaxation": paths, "constraint_network": constraints, "combination_finder": combinations, "assignment_preprocessing": assignment,
    "local_search_moves": local_search, "scenario_simulation": scenarios,
}


def lacks_exact(summary: DataFrame) -> bool:
    """Whether a traversal analysis has no point with exact frontier measures."""
    return summary.where("frontier_metric_source = 'exact'").isEmpty()
