"""The pivot-distance index against a plain program: ties, copies, odd vectors, large numbers."""

import math
import random

import pytest

from quern.llm import pivot_index as index

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k, every):
    fine = {(i, tuple(math.floor(256 * x) for x in v)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, q in fine:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def found(spark, rows, k, every, schema=SCHEMA):
    own = index.quantised(spark.createDataFrame(rows, schema))
    built = index.build_index(own, k)
    return sorted(tuple(r) for r in index.search(built, own.where(f"vec_id % {every} = 0"), k).collect()) if built else []


@pytest.mark.parametrize("norms", [False, True])
def test_equals_brute_force(spark, norms, monkeypatch):
    monkeypatch.setattr(index, "QUERY_VALUES", 96)  # some batches
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) * (rng.random() ** 3 * 9 if norms else 1) for _ in range(6)]) for i in range(700)]
    rows += [(1000 + i, [0.5, -0.25, 1.0, 0.0, 0.0, 2.0]) for i in range(350)]  # copies: a third of all rows
    rows += [(2000 + i, [float(i % 2), 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]  # ties
    assert found(spark, rows, 5, 50) == plain(rows, 5, 50)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [3.0], 1), (50, None, 1), (None, [1.0, 1.0], 1), (100, [1.0, None], 1), (150, [float("nan"), 1.0], 1), (200, [float("inf"), 0.0], 1), (250, [], 1), (300, [0.0, 0.0], 1), (7, [-1.0, 2.0], 1)]
    got = found(spark, rows, 5, 50, SCHEMA + ", v long")
    assert got == plain(rows, 5, 50) and (300, 4, 250, 0) in got
    assert found(spark, [], 5, 50) == []
    with pytest.raises(ValueError, match="64 bits"):
        found(spark, [(0, [1e30]), (1, [1.0])], 5, 50)


def test_large_whole_numbers_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randint(-(1 << 20), 1 << 20) + rng.random() for _ in range(3)]) for i in range(300)]
    assert found(spark, rows, 3, 10) == plain(rows, 3, 10)

