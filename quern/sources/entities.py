"""Deterministic entity tables: one row per id of a DataFrame with a whole column ``i``.

``numbered`` gives the ids 0 .. n - 1, ``keyed`` those of any table's key. All reals are float32.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.scalars import bit, bit_if, bits, f, ratio, real, root, squared_distance

I = F.col  # noqa: E741


def numbered(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"))


def keyed(table: DataFrame, key: str) -> DataFrame:
    return table.select(F.col(key).cast("long").alias("i"))


def _lin(a: int, b: int, m: int) -> Column:
    """(a * i + b) modulo m as a whole number."""
    return ((F.col("i") * a + b) % m).cast("int")


def _rows(ids: DataFrame, name: str, **columns: Column) -> DataFrame:
    return ids.select(F.col("i").alias(name), *[c.alias(k) for k, c in columns.items()])


def smoke_values(ids: DataFrame) -> DataFrame:
    x = (F.col("i") % 1024 + 1).cast("double") * 0.001
    return _rows(ids, "i", x=x, y=x * x + x * 2.0 + 1.0)


def polynomial_domain(ids: DataFrame) -> DataFrame:
    return _rows(ids, "i", x=(F.col("i") % 4096 + 1).cast("double") * 100.0)


def polynomial_coefficients(degree: int = 15) -> list[float]:
    out, power = [], 1.0
    for d in range(degree + 1):
        out.append((-1.0) ** d / (d + 1) * power)
        power *= 1e-5
    return out


def cost_tasks(ids: DataFrame) -> DataFrame:
    return _rows(
        ids, "task_id", x=real(_lin(17, 0, 1600)) * f(0.45), y=real(_lin(31, 13, 1600)) * f(0.35), deadline=f(150) + real(_lin(19, 0, 120)) * f(3.5),
        priority=f(1) + real(_lin(1, 0, 7)) * f(0.35), skill=bit(_lin(1, 0, 8)), urgent=_lin(1, 0, 6) == 0,
    )


def cost_resources(ids: DataFrame) -> DataFrame:
    return _rows(
        ids, "resource_id", x=real(_lin(29, 7, 1600)) * f(0.42), y=real(_lin(43, 5, 1600)) * f(0.38), load=ratio(real(_lin(11, 0, 101)), f(100)),
        speed=f(0.85) + real(_lin(1, 0, 6)) * f(0.18), available=real(_lin(23, 0, 90)) * f(2), mask=bits(_lin(1, 0, 8), _lin(1, 3, 8), _lin(1, 5, 8)),
    )


def tracks(ids: DataFrame) -> DataFrame:
    x0, y0 = real(_lin(37, 11, 2000)) * f(0.5), real(_lin(53, 19, 2000)) * f(0.5)
    return _rows(
        ids, "track_id", x0=x0, y0=y0, x1=x0 + real(_lin(19, 0, 61) - 30) * f(5), y1=y0 + real(_lin(23, 0, 61) - 30) * f(4.5), speed=f(4) + real(_lin(7, 0, 37)) * f(0.65)
    )


def zones(ids: DataFrame) -> DataFrame:
    return _rows(
        ids, "zone_id", x=real(_lin(59, 7, 2000)) * f(0.5), y=real(_lin(71, 29, 2000)) * f(0.5), radius=f(28) + real(_lin(1, 0, 9)) * f(14), severity=f(1) + real(_lin(1, 0, 6)) * f(0.45)
    )


def constraint_tasks(ids: DataFrame) -> DataFrame:
    start = _lin(13, 0, 900)
    return _rows(
        ids, "task_id", x=real(_lin(37, 11, 2000)) * f(0.5), y=real(_lin(53, 19, 2000)) * f(0.5), need=bit(_lin(1, 0, 8)).bitwiseOR(bit_if(_lin(1, 0, 5) == 0, _lin(1, 3, 8))),
        demand=_lin(7, 0, 8) + 1, earliest=start, latest=start + 90 + _lin(1, 0, 6) * 30, zone=_lin(1, 0, 8), risk=f(0.15) + ratio(real(_lin(29, 0, 85)), f(100)),
    )


def constraint_resources(ids: DataFrame) -> DataFrame:
    mask = bits(_lin(1, 0, 8), _lin(3, 1, 8)).bitwiseOR(bit_if(_lin(1, 0, 4) == 0, _lin(1, 5, 8)))
    return _rows(
        ids, "resource_id", x=real(_lin(97, 23, 2000)) * f(0.5), y=real(_lin(71, 41, 2000)) * f(0.5), mask=mask, capacity=_lin(5, 0, 10) + 2, opens=_lin(1, 0, 6) * 40,
        closes=_lin(1, 0, 5) * 50 + 1120, forbid=bit(_lin(5, 2, 8)).bitwiseOR(bit_if(_lin(1, 0, 9) == 0, _lin(1, 3, 8))), reach=f(180) + real(_lin(1, 0, 7)) * f(55),
        tolerance=f(0.35) + ratio(real(_lin(11, 0, 65)), f(100)),
    )


def constraint_candidates(ids: DataFrame, tasks: int, resources: int) -> DataFrame:
    task = _lin(37, 17, tasks)
    start = ((F.col("i") * 11 + F.floor(F.col("i") / 17) * 23) % 1300).cast("int")
    return _rows(ids, "candidate_id", task_id=task.cast("long"), resource_id=_lin(53, 3, resources).cast("long"), start=start, duration=(((F.col("i") * 7 + task) % 100) + 20).cast("int"))


def items(ids: DataFrame) -> DataFrame:
    cover = bit(_lin(5, 2, 6)).bitwiseOR(bit_if(_lin(1, 0, 11) == 0, _lin(1, 3, 6))).bitwiseOR(bit_if(_lin(1, 0, 17) == 0, _lin(1, 5, 6)))
    return _rows(ids, "item_id", value=_lin(37, 11, 180) + 20, cost=_lin(19, 7, 80) + 5, risk=_lin(23, 3, 60) + 1, x=_lin(29, 17, 1000), y=_lin(43, 31, 1000), cover=cover)


def assignment_tasks(ids: DataFrame) -> DataFrame:
    earliest, duration = _lin(13, 0, 600), _lin(1, 0, 90) + 20
    return _rows(
        ids, "task_id", x=real(_lin(37, 11, 4000)) * f(0.25), y=real(_lin(53, 23, 4000)) * f(0.25), need=bit(_lin(1, 0, 8)).bitwiseOR(bit_if(_lin(1, 0, 7) == 0, _lin(1, 3, 8))),
        demand=_lin(1, 0, 5) + 1, earliest=earliest, duration=duration, latest=earliest + duration + 120 + _lin(5, 0, 220), zone=_lin(1, 0, 12),
        priority=f(1) + ratio(real(_lin(17, 0, 100)), f(20)), risk=ratio(real(_lin(19, 0, 100)), f(100)),
    )


def assignment_resources(ids: DataFrame) -> DataFrame:
    opens = _lin(17, 0, 500)
    mask = bits(_lin(1, 0, 8), _lin(1, 2, 8), _lin(1, 5, 8)).bitwiseOR(F.when(_lin(1, 0, 11) == 0, 255).otherwise(0))
    return _rows(
        ids, "resource_id", x=real(_lin(31, 7, 4000)) * f(0.25), y=real(_lin(47, 29, 4000)) * f(0.25), mask=mask, capacity=_lin(1, 0, 7) + 2, opens=opens,
        closes=opens + 300 + _lin(13, 0, 300), forbid=bit_if(_lin(1, 0, 5) == 0, _lin(1, 1, 12)).bitwiseOR(bit_if(_lin(1, 0, 9) == 0, _lin(1, 4, 12))),
        reach=real(_lin(7, 0, 280) + 240), tolerance=f(0.35) + ratio(real(_lin(11, 0, 65)), f(100)), load=ratio(real(_lin(23, 0, 100)), f(100)),
    )


def search_tasks(ids: DataFrame, resources: int) -> DataFrame:
    return _rows(
        ids, "task_id", x=real(_lin(37, 13, 4096)) * f(0.2), y=real(_lin(61, 29, 4096)) * f(0.2), need=bits(_lin(1, 0, 8), _lin(1, 3, 8)), demand=_lin(1, 0, 5) + 1,
        priority=f(1) + ratio(real(_lin(11, 0, 100)), f(25)), risk=ratio(real(_lin(17, 7, 100)), f(100)), current=_lin(7, 3, resources).cast("long"),
    )


def search_resources(ids: DataFrame) -> DataFrame:
    return _rows(
        ids, "resource_id", x=real(_lin(41, 5, 4096)) * f(0.2), y=real(_lin(67, 19, 4096)) * f(0.2), mask=bits(_lin(1, 0, 8), _lin(1, 3, 8), _lin(1, 5, 8)), capacity=_lin(1, 0, 7) + 2,
        reach=real(_lin(13, 0, 240) + 110), tolerance=f(0.25) + ratio(real(_lin(23, 0, 75)), f(100)), load=ratio(real(_lin(31, 0, 100)), f(100)),
    )


def search_moves(ids: DataFrame, tasks: int, resources: int) -> DataFrame:
    target = (F.col("i") * 53 + 17 + F.floor(F.col("i") / 97)) % resources
    return _rows(ids, "move_id", task_id=_lin(37, 11, tasks).cast("long"), resource_id=target.cast("long"))


def scenario_tasks(ids: DataFrame) -> DataFrame:
    return _rows(
        ids, "task_id", x=real(_lin(37, 11, 2048)) * f(0.35), y=real(_lin(59, 23, 2048)) * f(0.35), demand=_lin(1, 0, 4) + 1, base=f(80) + real(_lin(17, 0, 180)),
        priority=f(1) + ratio(real(_lin(13, 0, 100)), f(30)), risk=f(0.035) + ratio(real(_lin(29, 7, 70)), f(650)), latest=f(120) + real(_lin(19, 0, 90)),
    )


def scenario_resources(ids: DataFrame) -> DataFrame:
    return _rows(
        ids, "resource_id", x=real(_lin(43, 5, 2048)) * f(0.35), y=real(_lin(71, 17, 2048)) * f(0.35), capacity=_lin(1, 0, 8) + 7, speed=f(7) + ratio(real(_lin(11, 0, 55)), f(10)),
        reliability=f(0.84) + ratio(real(_lin(23, 0, 15)), f(100)), tolerance=f(0.28) + ratio(real(_lin(31, 0, 55)), f(100)), fixed=f(20) + real(_lin(7, 0, 75)),
    )


def scenarios(ids: DataFrame, tasks: int, resources: int) -> DataFrame:
    """Uncertain worlds; no failed resource and no task with a spike are nulls."""
    return _rows(
        ids, "scenario_id", failed=F.when(_lin(17, 5, 23) == 0, _lin(13, 3, resources).cast("long")), spike=F.when(_lin(19, 7, 29) == 0, _lin(11, 1, tasks).cast("long")),
        delay=f(0.75) + ratio(real(_lin(37, 11, 60)), f(100)) + F.when(_lin(47, 3, 17) == 0, f(0.65)).otherwise(f(0)), cost=f(0.9) + ratio(real(_lin(41, 13, 55)), f(100)),
        risk=f(0.75) + ratio(real(_lin(53, 17, 60)), f(100)) + F.when(_lin(31, 5, 19) == 0, f(0.55)).otherwise(f(0)), weather=ratio(real(_lin(61, 19, 100)), f(100)),
    )


def base_plan(tasks: DataFrame, resources: DataFrame) -> DataFrame:
    """Each task of a scenario with its nearest capable resource; the smallest resource_id wins ties, and finishes are eased to what the plan needs."""
    r = resources.select(*[F.col(c).alias(f"r_{c}") for c in resources.columns])
    both = tasks.join(F.broadcast(r) if r.count() <= BROADCAST_ROWS else r)
    d2 = squared_distance(F.col("x"), F.col("y"), F.col("r_x"), F.col("r_y"))
    score = d2 + f(15) * F.col("r_fixed")
    score = score + F.when(F.col("r_capacity") >= F.col("demand") + 3, f(0)).otherwise(f(1e6))
    score = score + F.when(F.col("r_tolerance") >= F.col("risk") * f(1.4), f(0)).otherwise(f(1e6))
    travel = ratio(root(d2 + f(1)), F.col("r_speed") + f(1e-3))
    best = F.min(F.struct(score.alias("score"), F.col("r_resource_id"), *[F.col(c) for c in r.columns if c != "r_resource_id"], travel.alias("travel")))
    own = both.groupBy(*tasks.columns).agg(best.alias("b")).select(*tasks.columns, "b.*").drop("score")
    return own.withColumn("latest", F.greatest("latest", f(25) + f(1.45) * F.col("travel"))).drop("travel").withColumnRenamed("r_resource_id", "resource_id")


#: Entity tables of at most so many rows (some 60 bytes each) are broadcast.
BROADCAST_ROWS = 1_000_000


def uniform_doubles(spark: SparkSession, n: int, low: float, high: float, seed: int) -> DataFrame:
    """(i, x): the same seed gives the same data in [low, high)."""
    return numbered(spark, n).withColumn("x", F.lit(low) + (F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)) * (high - low))


def uniform_ints(spark: SparkSession, n: int, low: int, high: int, seed: int) -> DataFrame:
    """(i, x): whole numbers from low to high, both included."""
    return numbered(spark, n).withColumn("x", F.lit(low) + F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(high - low + 1)))


def edge_index(edges: DataFrame) -> DataFrame:
    """``edges`` sorted by (src, dst) with their numbers from 0, without a window over all rows: counts by source, offset by a prefix sum over ranges."""
    own = Window.partitionBy("src").orderBy("dst")
    ranked = edges.withColumn("k", F.row_number().over(own) - 1)
    return ranked.join(offsets(edges.groupBy("src").agg(F.count("*").alias("n"))), "src").withColumn("edge_index", F.col("first") + F.col("k")).drop("first", "k")


#: Sources are offset in ranges of so many ids; ranges are prefix-summed in one task.
RANGE = 1 << 16


def offsets(counts: DataFrame) -> DataFrame:
    """(src, first): the sum of ``n`` over all smaller ``src``."""
    c = counts.withColumn("range", F.floor(F.col("src") / RANGE))
    whole = c.groupBy("range").agg(F.sum("n").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for RANGE ids
    start = whole.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("range").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    return c.join(start, "range").select("src", (F.col("start") + F.coalesce(F.sum("n").over(own), F.lit(0))).alias("first"))
