"""Result rows: their schema, readers of JSON lines and CSV, and writers of lines, tables, matrices and bundles.

Readers take any path that Spark reads. Writers stamp every row with a sequence, so that rows keep the order in which they were made over any number of appends and
part files; rows without it follow their file's time and their line. First and last rows of a group go by that order.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.scalars import skill_names
from quern.operators import evaluators as ev

C = F.col
RESULT_DDL = (
    "benchmark string, variant string, preset string, repeat int, warmup int, input_size map<string,bigint>, total_ms double, h2d_ms double, "
    "kernel_ms double, d2h_ms double, correct boolean, device string, notes string, metadata map<string,string>"
)
FIELDS = [f.strip().split(" ")[0] for f in RESULT_DDL.replace("map<string,bigint>", "m").replace("map<string,string>", "m").split(",")]


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files with ``file``, its time, and ``line``, from 1 in each file. Blank lines count."""
    meta = [C("_metadata.file_path").alias("file"), C("_metadata.file_modification_time").alias("time"), C("_metadata.file_block_start").alias("_start")]
    raw = spark.read.text(path).select("value", *meta, F.monotonically_increasing_id().alias("_id"))
    own = Window.partitionBy("file").orderBy("_start", "_id")  # within a block ids follow the lines
    return raw.withColumn("line", F.row_number().over(own).cast("long")).drop("_start", "_id")


def read_jsonl(spark: SparkSession, path: str, benchmark: str | None = None) -> DataFrame:
    """Result rows with ``place``, by which they are ordered; blank lines are skipped, a bad line fails the job and is named."""
    lines = _numbered(spark, path).withColumn("value", F.trim("value")).where("value <> ''")
    parsed = F.from_json("value", RESULT_DDL + ", bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    rows = lines.select("line", "file", "time", "value", parsed.alias("r"))
    error = F.raise_error(F.concat(F.lit("invalid result on line "), C("line").cast("string"), F.lit(" of "), C("file"), F.lit(": "), C("value")))
    wrong = C("r").isNull() | C("r.bad").isNotNull() | C("r.benchmark").isNull()
    place = F.struct(F.coalesce(C("r.metadata")["sequence"], F.lit("")).alias("sequence"), "time", "file", "line").alias("place")
    rows = rows.select(place, F.when(wrong, error.cast("string")).otherwise(C("r.benchmark")).alias("benchmark"), *[C(f"r.{f}").alias(f) for f in FIELDS[1:]])
    rows = rows.withColumns({"repeat": F.coalesce("repeat", F.lit(1)), "correct": F.coalesce("correct", F.lit(False)), "total_ms": F.coalesce("total_ms", F.lit(0.0))})
    return rows if benchmark is None else rows.where(C("benchmark") == benchmark)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header; rows that do not fit the schema fail the job."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, column, value) of a headerless wide matrix; files follow each other by name, as their writer numbers them."""
    lines = _numbered(spark, path).where("value <> ''")
    own = lines.withColumn("row", F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1)
    sizes = own.groupBy("file").agg(F.count("*").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    cells = own.join(starts, "file").select((C("row") + C("before")).alias("row"), F.posexplode(F.split("value", ",")).alias("column", "value"))
    return cells.select("row", C("column").cast("long").alias("column"), C("value").cast("double").alias("value"))


def to_json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object a row, without empty metadata."""
    full = F.when(F.size(F.coalesce("metadata", F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))) > 0, C("metadata"))
    return rows.select(F.to_json(F.struct(*FIELDS[:-1], full.alias("metadata"))).alias("value"))


def write_jsonl(rows: DataFrame, path: str, append: bool = True) -> None:
    to_json_lines(rows).write.mode("append" if append else "overwrite").text(path)


def result_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Result rows made on the driver, of which there are few, each with its place in the order of all rows ever made."""
    now = time.time_ns()
    stamped = [r | {"metadata": {"sequence": f"{now:020d}-{k:06d}"} | (r.get("metadata") or {})} for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(f) for f in FIELDS) for r in stamped], RESULT_DDL)


def console(rows: DataFrame) -> str:
    """The rows as a table of text; for the few rows of one run."""
    head = ("benchmark", "variant", "preset", "total_ms", "kernel_ms", "correct")
    lines = [head, *[tuple(f"{r[h]:.3f}" if isinstance(r[h], float) else str(r[h]) for h in head) for r in rows.select(*head).collect()]]
    width = [max(len(x[i]) for x in lines) for i in range(len(head))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(x, width)).rstrip() for x in lines)


# Exports


def wide(cells: DataFrame, row: str, column: str, value: Column, columns: int) -> DataFrame:
    """A long matrix as one line of text for each row, ``columns`` values from column 0 on; cells that a row lacks are nan. A row must fit a line."""
    own = F.map_from_entries(F.collect_list(F.struct(C(column).cast("long").alias("c"), value.cast("string").alias("v"))))
    lines = cells.groupBy(row).agg(own.alias("m"))
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(max(columns, 1) - 1).cast("long")), lambda c: F.coalesce(C("m")[c], F.lit("nan")))
    return lines.select(row, F.array_join(each, ",").alias("value")).orderBy(row).select("value")


def write_bundle(path: str, tables: dict[str, DataFrame], matrices: dict[str, DataFrame] | None = None, metadata: dict | None = None) -> None:
    """CSV tables with headers, headerless matrices and metadata.json, each in its own folder below ``path``."""
    spark = next(iter(tables.values())).sparkSession
    for name, t in tables.items():
        t.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    for name, m in (matrices or {}).items():
        m.write.mode("overwrite").text(f"{path}/{name}")
    text = json.dumps(metadata or {}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata.json")


def export_cost(path: str, tasks: DataFrame, resources: DataFrame) -> None:
    n, m = tasks.count(), resources.count()
    pairs = ev.cost_pairs(tasks, resources)
    matrices = {
        "costs": wide(pairs, "task_id", "resource_id", F.coalesce("cost", F.lit(1e30).cast("float")), m), "feasible": wide(pairs, "task_id", "resource_id", C("feasible").cast("int"), m),
    }
    write_bundle(path, {"tasks": tasks, "resources": resources}, matrices, {"tasks": n, "resources": m})


def export_spatial(path: str, tracks: DataFrame, zones: DataFrame) -> None:
    n, m = tracks.count(), zones.count()
    whole, events = ev.spatial_matrix(tracks, zones), ev.spatial_events(tracks, zones)
    named = events.select("track_id", "zone_id", "code", ev.event_name(C("code")).alias("event_name"), "score")
    matrices = {"event_codes": wide(whole, "track_id", "zone_id", C("code"), m), "scores": wide(whole, "track_id", "zone_id", C("score"), m)}
    write_bundle(path, {"tracks": tracks, "zones": zones, "triggered_events": named}, matrices, {"tracks": n, "zones": m})


def export_constraints(path: str, tasks: DataFrame, resources: DataFrame, candidates: DataFrame) -> None:
    m = resources.count()
    pairs, found = ev.pair_compatibility(tasks, resources), ev.evaluate_candidates(candidates, tasks, resources)
    bits = [(C("mask").bitwiseAND(1 << k) != 0).cast("int").alias(n + "_violation") for k, n in enumerate(ev.CONSTRAINTS)]
    tables = {
        "tasks": tasks.withColumn("skills", skill_names(C("need"))), "resources": resources.withColumn("skills", skill_names(C("mask"))), "pair_compatibility": pairs,
        "candidate_evaluations": found.select("*", (C("start") + C("duration")).alias("end_time"), *bits),
    }
    passed = F.array(*[C(c).cast("int") for c in pairs.columns if c.endswith("_ok") and c != "pair_ok"])
    score = F.aggregate(passed, F.lit(0), lambda a, x: a + x)
    matrices = {"pair_ok": wide(pairs, "task_id", "resource_id", C("pair_ok").cast("int"), m), "pair_passes": wide(pairs, "task_id", "resource_id", score, m)}
    counts = pairs.agg(F.count_if("pair_ok")).first()[0], found.agg(F.count_if("valid")).first()[0]
    write_bundle(path, tables, matrices, {"tasks": tasks.count(), "resources": m, "pair_ok_count": counts[0], "valid_candidate_count": counts[1]})


def export_assignment(path: str, tasks: DataFrame, resources: DataFrame, k: int) -> None:
    m = resources.count()
    pairs = ev.assignment_pairs(tasks, resources)
    top = ev.padded(ev.top_assignments(ev.feasible_assignments(tasks, resources), k), tasks, k)
    matrices = {
        "pair_feasibility": wide(pairs, "task_id", "resource_id", (C("mask") == 0).cast("int"), m), "pair_cost": wide(pairs, "task_id", "resource_id", F.coalesce("cost", F.lit(-1).cast("float")), m),
    }
    write_bundle(path, {"tasks": tasks, "resources": resources, "topk_candidates": top}, matrices, {"tasks": tasks.count(), "resources": m, "top_k": k})


def export_moves(path: str, moves: DataFrame, tasks: DataFrame, resources: DataFrame) -> None:
    write_bundle(path, {"tasks": tasks, "resources": resources, "candidate_moves": ev.evaluate_moves(moves, tasks, resources)}, None, {"tasks": tasks.count(), "resources": resources.count()})


def export_scenarios(path: str, scenarios: DataFrame, plan: DataFrame, resources: DataFrame) -> None:
    own = plan.select(*[c for c in plan.columns if not c.startswith("r_")])
    write_bundle(path, {"tasks": own, "resources": resources, "scenarios": ev.evaluate_scenarios(scenarios, plan)}, None, {"tasks": plan.count(), "resources": resources.count()})


def export_graph(path: str, edges: DataFrame, nodes: DataFrame, labels: DataFrame | None = None, metadata: dict | None = None) -> None:
    """Edges, nodes with their degrees, and with ``labels`` (node, label) components and their sizes."""
    from quern.operators.graph import degrees
    from quern.sources.graphs import first_appearance

    own = degrees(edges, nodes).withColumnRenamed("degree", "out_degree")
    tables = {"edges": edges}
    if labels is not None:
        indexed = first_appearance(labels)
        sizes = indexed.groupBy("label", "component_index").agg(F.count("*").alias("size"))
        tables["components"] = sizes
        own = own.join(indexed.join(sizes.drop("component_index"), "label"), "node")
    tables["nodes"] = own.join(nodes, "node") if len(nodes.columns) > 1 else own
    write_bundle(path, tables, None, metadata)


def markdown(rows: DataFrame) -> str:
    """The rows of a report as a Markdown table; for the few rows of a sweep."""
    found = rows.collect()
    text = lambda x: "" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x).replace("\n", " ").replace("|", "\\|")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(text, r)) + " |" for r in found])


def write_analysis(path: str, rows: DataFrame, benchmark: str) -> DataFrame:
    """The analysis of one workload as CSV, and as a Markdown report with all its rows, below ``path``; gives the analysis."""
    from quern.plans import analytics

    found = analytics.ANALYSES[benchmark](rows)
    found.write.mode("overwrite").option("header", True).csv(f"{path}/{benchmark}_summary")
    notes = "\n".join(f"* {x}" for x in analytics.bfs_diagnosis(found)) + "\n\n" if benchmark == "graph_bfs" else ""
    text = f"# {benchmark}\n\n{notes}{markdown(found)}\n\n## Rows\n\n{markdown(analytics.report(rows.where(C('benchmark') == benchmark)))}\n"
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{benchmark}_report.md")
    return found
