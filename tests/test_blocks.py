"""Block walks, ranges of ranks and array programs against plain programs and the column expressions."""

import heapq
import itertools
import math
import random

import numpy as np
import pytest

from quern.operators import blocks, plain
from quern.operators import evaluators as ev
from quern.operators import graph as go
from quern.plans.validate import validate
from quern.sources import entities as en
from quern.sources import graphs as gr


def nearest(edges, source=0):
    best, heap = {source: 0}, [(0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if d > best[v]:
            continue
        for s, t, w in edges:
            if s == v and d + w < best.get(t, math.inf):
                best[t] = d + w
                heapq.heappush(heap, (d + w, t))
    return best


@pytest.mark.parametrize("block", [5, 60, 1 << 18])
def test_walks_equal_a_queue_whatever_the_blocks(spark, block):
    rng = random.Random(block)
    e = [(rng.randrange(50), rng.randrange(70), rng.randrange(9)) for _ in range(140)] + [(5, k, 3) for k in range(40)] + [(0, 5, 1)]  # a hub over several blocks
    stored = blocks.store(spark.createDataFrame(e, "src long, dst long, weight long"), block)
    assert sorted(tuple(r) for r in stored.edges().collect()) == sorted(e)
    run = go.Run()
    assert {r["node"]: r["distance"] for r in blocks.distances(stored, 0, run).collect()} == nearest(e)
    assert run.converged and run.iterations >= 1 and run.active_visits > 0
    degree = {r["node"]: r["degree"] for r in stored.degrees().collect()}
    assert degree == {v: sum(s == v for s, _, _ in e) for v in {s for s, _, _ in e}}


def test_deep_graphs_have_no_limit_of_rounds(spark):
    far = go.bfs(gr.chain(spark, 3000), 0)
    assert far.agg({"depth": "max"}).first()[0] == 2999 and far.count() == 3000
    stored = blocks.store(gr.chain(spark, 120), 7)
    with pytest.raises(RuntimeError):
        blocks.distances(stored, 0, max_rounds=2)
    none = spark.createDataFrame([], "src long, dst long")
    assert [tuple(r) for r in go.bfs(none, 4).collect()] == [(4, 0)]


def test_ranks_are_unranked_in_order():
    for n, k in ((5, 1), (6, 2), (7, 3), (8, 4), (4, 4)):
        total = math.comb(n, k)
        got = np.stack(plain.unrank(np.arange(total), n, k), 1).tolist()
        assert [tuple(c) for c in got] == list(itertools.combinations(range(n), k))


@pytest.mark.parametrize("n, k", [(40, 2), (25, 3), (14, 4), (3, 3), (2, 3)])
def test_combinations_by_rank_equal_joins(spark, n, k, monkeypatch):
    items = en.items(en.numbered(spark, n))
    rows = lambda d: sorted(map(repr, d.select("members", "rank", "mask", "score").collect()))
    joined = ev.joined_combinations(items, k)
    assert rows(ev.evaluate_combinations(items, k)) == rows(joined)
    names = ("valid_count", "invalid_count", *ev.COMBINATIONS, "best_score", "best_rank")
    assert ev.combination_totals(items, k).select(*names).collect() == ev.combination_summary(joined).select(*names).collect()
    with pytest.raises(ValueError):
        ev.evaluate_combinations(items, 5)


def test_scenarios_in_parts_equal_the_fold(spark):
    ids = lambda n: en.numbered(spark, n)
    plan = en.base_plan(en.scenario_tasks(ids(30)), en.scenario_resources(ids(9)))
    worlds = en.scenarios(ids(200), 30, 9)
    want = sorted(map(repr, ev.folded_scenarios(worlds, plan).collect()))
    for rows in (7, 1 << 18):
        assert sorted(map(repr, plain.scenarios(worlds, plan, rows).select(*ev.folded_scenarios(worlds, plan).columns).collect())) == want


def test_array_programs_check_the_expressions(spark):
    ids = lambda n: en.numbered(spark, n)
    e = en.constraint_candidates(ids(900), 40, 20), en.constraint_tasks(ids(40)), en.constraint_resources(ids(20))
    assert validate("constraint_network", plain.candidates(*e), ev.evaluate_candidates(*e)).first()["correct"]
    assert not validate("constraint_network", plain.candidates(e[0], e[1], e[2].withColumn("reach", e[2]["reach"] / 2)), ev.evaluate_candidates(*e)).first()["correct"]
    m = en.search_moves(ids(900), 40, 20), en.search_tasks(ids(40), 20), en.search_resources(ids(20))
    assert validate("local_search_moves", plain.moves(*m), ev.evaluate_moves(*m)).first()["correct"]
    c = en.cost_tasks(ids(40)), en.cost_resources(ids(30))
    assert validate("cost_matrix", plain.costs(*c), ev.cost_pairs(*c)).first()["correct"]
    assert validate("foundation_smoke", plain.smoke(ids(3000)), en.smoke_values(ids(3000))).first()["correct"]
