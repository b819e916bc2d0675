"""Comparison of results with a reference, by key: exact columns, one real column within a tolerance, and checksums of both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col


@dataclass(frozen=True)
class Rule:
    """``real`` fails beyond max(absolute, relative * |reference|), or with ``both`` only beyond each of the two."""

    key: tuple[str, ...]
    exact: tuple[str, ...] = ()
    real: str | None = None
    absolute: float = 0.0
    relative: float = 0.0
    both: bool = False
    finite: bool = False


# Keys, columns and tolerances of each workload.
RULES = {
    "foundation_smoke": Rule(("i",), real="y", absolute=1e-6, relative=1e-10),
    "polynomial_batch": Rule(("i",), real="y", absolute=1e-9, relative=1e-11, finite=True),
    "cost_matrix": Rule(("task_id", "resource_id"), ("feasible",), "cost", 1e-3, 1e-5),
    "spatial_events": Rule(("track_id", "zone_id"), ("code",), "score", 1e-5, 1e-5),
    "constraint_network": Rule(("candidate_id",), ("valid", "mask", "violations"), "penalty", 5e-2, 1e-5, both=True),
    "combination_finder": Rule((), ("valid_count", "invalid_count", "budget", "risk", "coverage", "spread", "best_score", "checksum")),
    "assignment_preprocessing": Rule(("task_id", "rank"), ("resource_id",), "cost", 5e-3, 1e-5, both=True),
    "local_search_moves": Rule(("move_id",), ("valid", "improving", "mask"), "delta", 5e-3, 1e-5, both=True),
    "scenario_simulation": Rule(("scenario_id",), ("feasible", "mask", "violations", "failure_count", "capacity_count", "risk_count", "delay_count"), "score", 1e-2, 1e-5, both=True),
    "graph_bfs": Rule(("node",), ("depth",)),
    "graph_connected_components": Rule(("node",), ("label",)),
    "graph_weighted_relaxation": Rule(("node",), ("distance",)),
}


def compare(actual: DataFrame, reference: DataFrame, rule: Rule) -> DataFrame:
    """One row: compared, missing, mismatches, max_abs_error, max_rel_error, checksum, reference_checksum, correct.

    Rows of one side alone are missing; repeated keys are a mismatch each time. Relative errors are over max(1, |reference|). A real value that is null on both sides is equal.
    """
    key = rule.key or ("_one",)
    cols = [*rule.exact, *([rule.real] if rule.real else [])]

    def side(df: DataFrame, name: str) -> DataFrame:
        df = df if rule.key else df.withColumn("_one", F.lit(1))
        return df.groupBy(*key).agg(F.struct(*[F.min(c).alias(c) for c in cols], F.count("*").alias("n")).alias(name))

    both = side(actual, "a").join(side(reference, "r"), list(key), "full_outer")
    missing = C("a").isNull() | C("r").isNull()
    bad = (C("a.n") > 1) | (C("r.n") > 1)
    for c in rule.exact:
        bad = bad | ~C(f"a.{c}").eqNullSafe(C(f"r.{c}"))
    out = [F.count("*").alias("compared"), F.count_if(missing).alias("missing")]
    if rule.real:
        x, y = C(f"a.{rule.real}").cast("double"), C(f"r.{rule.real}").cast("double")
        error = F.abs(x - y)
        part = error / F.greatest(F.lit(1.0), F.abs(y))
        beyond = ((error > rule.absolute) & (part > rule.relative)) if rule.both else error > F.greatest(F.lit(rule.absolute), rule.relative * F.abs(y))
        bad = bad | x.isNull().eqNullSafe(y.isNotNull()) | F.coalesce(beyond, F.lit(False))
        if rule.finite:
            bad = bad | F.isnan(x) | (F.abs(x) == float("inf"))
        sums = [F.sum(x), F.sum(y)]
        out += [F.coalesce(F.max(error), F.lit(0.0)).alias("max_abs_error"), F.coalesce(F.max(part), F.lit(0.0)).alias("max_rel_error")]
    else:
        last = rule.exact[-1]
        place = C(rule.key[0]) + 1 if rule.key else F.lit(1)
        sums = [F.sum(C(f"{s}.{last}").cast("long") * place) for s in ("a", "r")]
        out += [F.lit(0.0).alias("max_abs_error"), F.lit(0.0).alias("max_rel_error")]
    out += [F.count_if(~missing & bad).alias("mismatches"), sums[0].alias("checksum"), sums[1].alias("reference_checksum")]
    return both.agg(*out).withColumn("correct", (C("missing") == 0) & (C("mismatches") == 0))


def validate(workload: str, actual: DataFrame, reference: DataFrame) -> DataFrame:
    if workload not in RULES:
        raise ValueError(f"unknown workload: {workload}")
    return compare(actual, reference, RULES[workload])
