"""Column functions that operators share.

Thresholds of the evaluators fall on exact values, so reals are float32 throughout: literals through ``f`` and
quotients and roots, which Spark computes in double, cast back.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = (1 << 32) - 1


def f(x: float) -> Column:
    return F.lit(x).cast("float")


def real(x: Column) -> Column:
    return x.cast("float")


def ratio(a: Column, b: Column | float) -> Column:
    return (a / b).cast("float")


def root(x: Column) -> Column:
    return F.sqrt(x).cast("float")


def squared_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """In the type of its arguments: float32, or whole numbers."""
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def clamp01(x: Column) -> Column:
    return F.greatest(f(0), F.least(f(1), x))


def bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), n.cast("int"))


def bits(*numbers: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), map(bit, numbers))


def bit_if(condition: Column, number: Column) -> Column:
    return F.when(condition, bit(number)).otherwise(0)


def has_any(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b) != 0


def has_all(have: Column, need: Column) -> Column:
    return have.bitwiseAND(need) == need


def zone_forbidden(mask: Column, zone: Column) -> Column:
    return has_any(mask, bit(zone.bitwiseAND(F.lit(31))))


def flags(*conditions: Column) -> Column:
    """Bit k is set where the k-th condition holds."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)])


def popcount(x: Column, width: int = 32) -> Column:
    return F.bit_count(x.bitwiseAND((1 << width) - 1)).cast("int")


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether the closed intervals meet."""
    return F.greatest(a0, b0) <= F.least(a1, b1)


def horner(x: Column, coefficients: list[float]) -> Column:
    """The polynomial with these coefficients, lowest degree first."""
    return reduce(lambda a, c: a * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def choose(n: Column | int, k: int) -> Column | int:
    """Binomial coefficient for a fixed k; 0 below it."""
    if isinstance(n, int):
        return math.comb(n, k) if n >= 0 else 0
    out = F.lit(1).cast("long")
    for j in range(k):  # the product of j + 1 neighbours is divisible by (j + 1)!
        out = out * (n.cast("long") - j)
    return F.when(n < k, F.lit(0).cast("long")).otherwise(_div(out, math.factorial(k)))


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b) if b == 1 else F.call_function("div", a, F.lit(b).cast("long"))


def combination_rank(n: int, members: list[Column]) -> Column:
    """Lexicographic number, from 0, of an ascending combination of 0 .. n - 1."""
    k, rank, last = len(members), F.lit(0).cast("long"), F.lit(-1)
    for j, m in enumerate(members):
        rank = rank + choose(F.lit(n) - last - 1, k - j) - choose(F.lit(n) - m, k - j)
        last = m
    return rank


def unrank(n: int, k: int, rank: Column) -> Column:
    """Array of the combination with this lexicographic number."""

    def step(state, j):
        left = F.lit(k) - j
        # The next member is the first whose block of combinations reaches the rest of the rank.
        sizes = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda m: F.coalesce(*[F.when(left == x, choose(F.lit(n) - 1 - m, x - 1)) for x in range(1, k + 1)]))
        walk = F.aggregate(
            F.zip_with(F.sequence(F.lit(0), F.lit(n - 1)), sizes, lambda m, s: F.struct(m.alias("m"), s.alias("s"))),
            F.struct(state["rest"].alias("rest"), F.lit(-1).alias("m")),
            lambda a, x: F.when((a["m"] >= 0) | (x["m"] <= state["last"]), a)
            .when(a["rest"] < x["s"], F.struct(a["rest"].alias("rest"), x["m"].alias("m")))
            .otherwise(F.struct((a["rest"] - x["s"]).alias("rest"), F.lit(-1).alias("m"))),
        )
        return F.struct(walk["rest"].alias("rest"), walk["m"].alias("last"), F.array_append(state["own"], walk["m"]).alias("own"))

    start = F.struct(rank.cast("long").alias("rest"), F.lit(-1).alias("last"), F.array().cast("array<int>").alias("own"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), start, step, lambda s: s["own"])


def lcg(x: Column) -> Column:
    """One step of the linear congruential generator modulo 2^32; x is a long."""
    return (x * 1664525 + 1013904223).bitwiseAND(U32)


def multiply_u32(a: int, x: Column) -> Column:
    """a * x modulo 2^32 for 0 <= x < 2^32, without leaving 64 bits."""
    high = F.shiftleft((x * (a >> 16)).bitwiseAND(0xFFFF), 16)
    return (high + (x * (a & 0xFFFF)).bitwiseAND(U32)).bitwiseAND(U32)


def lcg_steps(n: int) -> list[tuple[int, int]]:
    """(A, C) of the first n steps: state_n = A * state_0 + C modulo 2^32."""
    out, a, c = [], 1, 0
    for _ in range(n):
        a, c = a * 1664525 & U32, (c * 1664525 + 1013904223) & U32
        out.append((a, c))
    return out


def edge_weight(src: Column, dst: Column, index: Column) -> Column:
    """Deterministic weight 1 .. 31 of an edge, in 32-bit arithmetic."""
    x = (src.cast("long") * 1315423911).bitwiseAND(U32)
    y = (dst.cast("long") * 2654435761).bitwiseAND(U32)
    z = (index.cast("long") * 97).bitwiseAND(U32)
    return x.bitwiseXOR(y).bitwiseXOR(z) % 31 + 1


def skill_names(mask: Column, width: int = 8) -> Column:
    """``S0|S3`` for the bits set, ``none`` without any."""
    names = F.array_compact(F.array(*[F.when(mask.bitwiseAND(1 << k) != 0, f"S{k}") for k in range(width)]))
    return F.when(F.size(names) > 0, F.array_join(names, "|")).otherwise("none")


def six(x: Column) -> Column:
    """A number as text with six decimals."""
    return F.format_string("%.6f", x.cast("double"))


def label_delta(label: Column) -> Column:
    """Struct (case, delta) of labels like ``name_delta16``; nulls for others."""
    rule = r"^(.+)_delta(\d+)$"
    ok = label.rlike(rule)
    return F.struct(F.when(ok, F.regexp_extract(label, rule, 1)).alias("case"), F.when(ok, F.regexp_extract(label, rule, 2).cast("int")).alias("delta"))


def to_int(x: Column) -> Column:
    """Whole number of a text, null if it is none."""
    return x.try_cast("long")


def to_double(x: Column) -> Column:
    return x.try_cast("double")


# Other names of graph kinds.
ALIASES = {"random_sparse": "random", "chain_components": "chains", "grids": "grid_components", "random_clusters": "random"}


def kind(x: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """Graph kind under its usual name."""
    return F.coalesce(F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])[x], x)


def masked(feasible: Column, x: Column) -> Column:
    """The value where feasible, else null."""
    return F.when(feasible, x)
