"""Evaluators on hand-made rows, known answers of the generated entities, and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from quern.functions import scalars as sc
from quern.operators import evaluators as ev
from quern.sources import entities as en


def frame(spark, name, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl).withColumnsRenamed({"id": name})


def ids(spark, n):
    return en.numbered(spark, n)


ZONE = "id long, x float, y float, radius float, severity float"
TRACK = "id long, x0 float, y0 float, x1 float, y1 float, speed float"


def test_spatial_cases(spark):
    zones = frame(spark, "zone_id", ZONE, (0, 0.0, 0.0, 10.0, 2.0))
    ends = [(-20, 0, 0, 0), (0, 0, 20, 0), (0, 0, 5, 0), (-20, 0, 20, 0), (-30, 25, -20, 25), (3, 3, 3, 3)]
    tracks = frame(spark, "track_id", TRACK, *[(i, *map(float, e), 5.0) for i, e in enumerate(ends)])
    whole = {r["track_id"]: (r["code"], r["score"]) for r in ev.spatial_matrix(tracks, zones).collect()}
    assert [whole[i][0] for i in range(6)] == [1, 2, 3, 4, 0, 3]
    assert all((whole[i][1] > 0) == (i != 4) for i in range(6))
    assert {(r["track_id"], r["code"]) for r in ev.spatial_events(tracks, zones).collect()} == {(i, whole[i][0]) for i in (0, 1, 2, 3, 5)}


def test_cost_cases(spark):
    task = "id long, x float, y float, deadline float, priority float, skill int, urgent boolean"
    resource = "id long, x float, y float, load float, speed float, available float, mask int"
    tasks = frame(spark, "task_id", task, (0, 1.0, 1.0, 1000.0, 1.0, 1 << 7, False), (1, 1.0, 1.0, 1000.0, 1.0, 6, False))
    resources = frame(spark, "resource_id", resource, (0, 1.0, 1.0, 0.1, 1.0, 0.0, 6))
    got = {r["task_id"]: (r["feasible"], r["cost"]) for r in ev.cost_pairs(tasks, resources).collect()}
    assert got[0] == (False, None) and got[1][0]
    # Two common skills make one pair.
    assert [(r["task_id"], r["cost"]) for r in ev.cost_pairs(tasks, resources, feasible_only=True).collect()] == [(1, got[1][1])]


CN_TASK = "id long, x float, y float, need int, demand int, earliest int, latest int, zone int, risk float"
CN_RESOURCE = "id long, x float, y float, mask int, capacity int, opens int, closes int, forbid int, reach float, tolerance float"
CANDIDATE = "candidate_id long, task_id long, resource_id long, start int, duration int"


def test_constraint_cases(spark):
    tasks = frame(spark, "task_id", CN_TASK, (0, 0.0, 0.0, 3, 4, 100, 220, 2, 0.4), (1, 500.0, 500.0, 8, 8, 500, 550, 3, 0.95))
    resources = frame(spark, "resource_id", CN_RESOURCE, (0, 10.0, 0.0, 7, 5, 80, 300, 0, 100.0, 0.8), (1, 0.0, 0.0, 3, 2, 0, 400, 8, 10.0, 0.3))
    moves = spark.createDataFrame([(0, 0, 0, 120, 40), (1, 1, 1, 100, 500)], CANDIDATE)
    got = {r["candidate_id"]: r for r in ev.evaluate_candidates(moves, tasks, resources).collect()}
    assert (got[0]["valid"], got[0]["violations"], got[0]["mask"]) == (True, 0, 0)
    assert (got[1]["valid"], got[1]["violations"], got[1]["mask"]) == (False, 7, 127)
    s = ev.candidate_summary(ev.evaluate_candidates(moves, tasks, resources)).first()
    assert (s["valid_count"], s["invalid_count"], s["total_violations"], s["skill"], s["risk"]) == (1, 1, 7, 1, 1)
    ok = {(r["task_id"], r["resource_id"]): r["pair_ok"] for r in ev.pair_compatibility(tasks, resources).collect()}
    assert ok == {(0, 0): True, (0, 1): False, (1, 0): False, (1, 1): False}


def near(a, b, part=1e-6):
    return abs(a - b) <= part * max(1, abs(b))


def test_known_answers(spark):
    s = en.smoke_values(ids(spark, 1024)).agg(F.sum("y")).first()[0]
    assert near(s, 2432.0384)
    y = en.polynomial_domain(ids(spark, 1024)).agg(F.sum(sc.horner(F.col("x"), en.polynomial_coefficients()))).first()[0]
    assert near(y, 836.1591728713337, 1e-9)
    pairs = ev.cost_pairs(en.cost_tasks(ids(spark, 64)), en.cost_resources(ids(spark, 64)))
    s = ev.cost_summary(pairs).first()
    assert s["feasible_count"] == 1331 and near(s["checksum_milli"] / 1000, 355567.15, 1e-4)
    tracks, zones = en.tracks(ids(spark, 64)), en.zones(ids(spark, 32))
    s = {r["code"]: r for r in ev.spatial_summary(ev.spatial_events(tracks, zones), 64 * 32).collect()}
    assert [s[k]["events"] for k in range(5)] == [1910, 32, 68, 30, 8] and near(sum(r["score_milli"] for r in s.values()) / 1000, 939.334, 1e-3)
    found = ev.evaluate_candidates(en.constraint_candidates(ids(spark, 4096), 64, 32), en.constraint_tasks(ids(spark, 64)), en.constraint_resources(ids(spark, 32)))
    s = ev.candidate_summary(found).first()
    assert [s[c] for c in ("valid_count", "total_violations", *ev.CONSTRAINTS)] == [0, 17491, 4096, 2048, 3794, 769, 3136, 2048, 1600]
    tasks, resources = en.assignment_tasks(ids(spark, 64)), en.assignment_resources(ids(spark, 128))
    s = ev.assignment_reasons(ev.assignment_pairs(tasks, resources)).first()
    assert [s[c] for c in ("feasible", *ev.ASSIGNMENT)] == [311, 4785, 1413, 4531, 5219, 218, 2723]
    s = ev.assignment_summary(ev.top_assignments(ev.feasible_assignments(tasks, resources), 4), 64 * 128).first()
    assert (s["selected"], s["tasks_with_any"]) == (179, 52) and near(s["best_cost_milli"] / 1000, 13867.144, 1e-5)
    moves = ev.evaluate_moves(en.search_moves(ids(spark, 4096), 128, 256), en.search_tasks(ids(spark, 128), 256), en.search_resources(ids(spark, 256)))
    s = ev.move_summary(moves).first()
    assert [s[c] for c in ("valid_moves", "improving_moves", *ev.MOVES, "best_move")] == [102, 89, 3104, 693, 3263, 1508, 15, 4089]
    assert near(s["best_delta"], -19150.7129)
    plan = en.base_plan(en.scenario_tasks(ids(spark, 32)), en.scenario_resources(ids(spark, 16)))
    s = ev.scenario_summary(ev.evaluate_scenarios(en.scenarios(ids(spark, 4096), 32, 16), plan)).first()
    assert [s[c] for c in ("feasible_count", "failure_scenarios", "capacity_scenarios", "risk_scenarios", "delay_scenarios", "total_violations")] == [3929, 167, 0, 0, 0, 354]
    assert near(s["mean_score"], 6868.7307, 1e-5) and near(s["best_score"], 4649.063) and near(s["worst_score"], 40563.211) and near(s["robustness"], 17417.248, 1e-5)


@pytest.mark.parametrize(
    "n, k, valid, best, rank, checksum",
    [(16, 3, 13, 44831, 556, 6367645817), (64, 3, 153, 53015, 22205, 619873329184), (32, 4, 121, 68137, 32129, 578808434781)],
)
def test_combinations(spark, n, k, valid, best, rank, checksum):
    found = ev.evaluate_combinations(en.items(ids(spark, n)), k)
    s = ev.combination_summary(found).first()
    assert (s["valid_count"], s["best_score"], s["best_rank"], s["checksum"]) == (valid, best, rank, checksum)
    assert s["valid_count"] + s["invalid_count"] == math.comb(n, k) == ev.combinations_count(n, k)


def test_ranks_and_unranks(spark):
    assert (sc.choose(5, 2), sc.choose(6, 3), sc.choose(2, 3)) == (10, 20, 0)
    rows = spark.range(10).select(sc.unrank(5, 3, F.col("id")).alias("m")).collect()
    assert [r["m"] for r in rows][::9] == [[0, 1, 2], [2, 3, 4]] and len({tuple(r["m"]) for r in rows}) == 10
    with pytest.raises(ValueError):
        ev.evaluate_combinations(en.items(ids(spark, 4)), 5)


def test_scenario_branches_that_the_generators_never_reach(spark):
    plan = spark.createDataFrame(
        [(0, 0.0, 0.0, 9, 80.0, 1.0, 0.9, 1.0, 0, 100.0, 0.0, 5, 7.0, 0.2, 0.3, 20.0)],
        "task_id long, x float, y float, demand int, base float, priority float, risk float, latest float, resource_id long, r_x float, r_y float, r_capacity int, r_speed float, r_reliability float, r_tolerance float, r_fixed float",
    )
    worlds = spark.createDataFrame([(0, None, None, 1.0, 1.0, 1.0, 0.0), (1, 0, 0, 1.0, 1.0, 1.0, 0.0)], "scenario_id long, failed long, spike long, delay float, cost float, risk float, weather float")
    got = {r["scenario_id"]: r for r in ev.evaluate_scenarios(worlds, plan).collect()}
    assert got[0]["mask"] & 14 == 14 and got[1]["mask"] == 15 and got[1]["score"] > got[0]["score"]
    assert got[0]["violations"] == got[0]["failure_count"] + 3


def test_padding_usage_and_samples(spark):
    tasks, resources = en.assignment_tasks(ids(spark, 16)), en.assignment_resources(ids(spark, 20))
    top = ev.top_assignments(ev.feasible_assignments(tasks, resources), 4)
    whole = ev.padded(top, tasks, 4)
    assert whole.count() == 64 and whole.where("resource_id = -1 and cost < 1e29").count() == 0
    assert ev.resource_usage(whole).agg(F.sum("selected")).first()[0] == top.count()
    assert ev.sampled(whole, "task_id", 5, 1).count() == 5
    pairs = ev.assignment_pairs(tasks, resources)
    assert ev.downsampled(pairs, "task_id", "resource_id", 5).count() == 4 * 5
    assert pairs.count() == 320


def test_histogram_counts_all(spark):
    h = ev.histogram(spark.range(100).withColumn("x", F.col("id") * F.col("id")), "x", 7).orderBy("bin").collect()
    assert len(h) == 7 and sum(r["n"] for r in h) == 100 and h[0]["low"] == 0 and abs(h[-1]["high"] - 99 * 99) < 1e-6
    assert ev.histogram(spark.range(5).select(F.lit(3).alias("x")), "x", 3).agg(F.sum("n")).first()[0] == 5
    assert ev.histogram(spark.range(0).select(F.col("id").alias("x")), "x").count() == 0


def test_scalars(spark):
    r = spark.range(1).select(
        sc.skill_names(F.lit(9)).alias("a"), sc.skill_names(F.lit(0)).alias("b"), sc.six(F.lit(1.5)).alias("c"), sc.label_delta(F.lit("grid_delta16")).alias("d"), sc.label_delta(F.lit("grid")).alias("e"),
        sc.to_int(F.lit("x")).alias("f"), sc.to_double(F.lit("2.5")).alias("g"), sc.kind(F.lit("grids")).alias("h"), sc.kind(F.lit("chain")).alias("i"), sc.popcount(F.lit(127), 7).alias("j"),
        sc.masked(F.lit(False), F.lit(1)).alias("k"), sc.overlaps(F.lit(1), F.lit(2), F.lit(2), F.lit(3)).alias("l"), sc.lcg(F.lit(5).cast("long")).alias("m"),
    ).first()
    assert r["a"] == "S0|S3" and r["b"] == "none" and r["c"] == "1.500000" and tuple(r["d"]) == ("grid", 16) and tuple(r["e"]) == (None, None)
    assert (r["f"], r["g"], r["h"], r["i"], r["j"], r["k"], r["l"]) == (None, 2.5, "grid_components", "chain", 7, None, True)
    assert r["m"] == (5 * 1664525 + 1013904223) % 2**32 and sc.lcg_steps(1)[0] == (1664525, 1013904223)


def test_seeded_numbers(spark):
    a, b, c = (en.uniform_doubles(spark, 50, -1.0, 2.0, s).collect() for s in (1, 1, 2))
    assert a == b != c and all(-1 <= r["x"] < 2 for r in a)
    assert {r["x"] for r in en.uniform_ints(spark, 200, 3, 5, 1).collect()} == {3, 4, 5}


def test_empty_sides(spark):
    none = en.cost_resources(ids(spark, 0))
    assert ev.cost_summary(ev.cost_pairs(en.cost_tasks(ids(spark, 3)), none)).first()["pairs"] == 0
    assert ev.spatial_events(en.tracks(ids(spark, 0)), en.zones(ids(spark, 3))).count() == 0
    assert ev.move_summary(ev.evaluate_moves(en.search_moves(ids(spark, 0), 1, 2), en.search_tasks(ids(spark, 1), 2), en.search_resources(ids(spark, 2)))).first()["best_move"] == -1
