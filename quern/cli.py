"""Command line: run workloads, compare their plans, write result rows, analyse them.

Exit codes: 0, 2 if a result is wrong and validation is on or exact measures are required and absent, 1 on any error.
"""

from __future__ import annotations

import argparse
import sys

from quern.plans.harness import WORKLOADS, Config


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise ValueError(message)


def _positive(text: str) -> int:
    if int(text) <= 0:
        raise argparse.ArgumentTypeError("must be positive")
    return int(text)


def _natural(text: str) -> int:
    if int(text) < 0:
        raise argparse.ArgumentTypeError("must be non-negative")
    return int(text)


def _pair(text: str) -> tuple[str, str]:
    key, equals, value = text.partition("=")
    if not equals:
        raise argparse.ArgumentTypeError("expects key=value")
    return key, value


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="quern", description=__doc__, allow_abbrev=False)
    p.add_argument("--list", action="store_true", help="list the workloads")
    p.add_argument("--benchmark", default="all")
    p.add_argument("--preset", default="tiny")
    p.add_argument("--repeat", type=_positive, default=1)
    p.add_argument("--warmup", type=_natural, default=0)
    p.add_argument("--output", help="folder that result lines are appended to")
    p.add_argument("--no-validate", action="store_true", help="wrong results do not change the exit code")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--set", action="append", type=_pair, default=[], metavar="KEY=VALUE", help="a size of the preset, or sweep_label")
    p.add_argument("--sweep", action="store_true", help="run the workload at all points of its sweep")
    p.add_argument("--analyze", metavar="ROWS", help="analyse result lines instead of running; reports go to --output")
    p.add_argument("--require-exact", action="store_true", help="an analysis without exact frontier measures ends with code 2")
    return p


def analyze(a: argparse.Namespace, spark) -> int:
    """The report of each workload that the result lines hold."""
    from quern.plans import analytics
    from quern.sources import results

    rows = results.read_jsonl(spark, a.analyze)
    there = {r["benchmark"] for r in rows.select("benchmark").distinct().collect()}
    names = [n for n in analytics.ANALYSES if n in there and a.benchmark in ("all", n)]
    if not names:
        raise ValueError("no result lines of such a workload")
    code = 0
    for name in names:
        found = results.write_analysis(a.output, rows, name) if a.output else analytics.ANALYSES[name](rows)
        print(results.markdown(found))
        if name == "graph_weighted_relaxation":
            print(results.markdown(analytics.recommended(found)))
        if name == "graph_bfs":
            print("\n".join(analytics.bfs_diagnosis(found)))
            if a.require_exact and analytics.lacks_exact(found):
                code = 2
    return code


def parse(args: list[str]) -> Config:
    """The run that the arguments ask for; a ValueError names what is wrong with them."""
    a = parser().parse_args(args)
    return Config(a.benchmark, a.preset, a.repeat, a.warmup, not a.no_validate, a.output, a.verbose, dict(a.set))


def main(args: list[str] | None = None, spark=None) -> int:
    args = sys.argv[1:] if args is None else args
    try:
        config = parse(args)
        if "--list" in args:
            print("\n".join(WORKLOADS))
            return 0
        from pyspark.sql import SparkSession

        from quern.plans import harness
        from quern.sources import results

        spark = spark or SparkSession.builder.getOrCreate()
        asked = parser().parse_args(args)
        if asked.analyze:
            return analyze(asked, spark)
        if asked.sweep and config.benchmark not in harness.SWEEPS:
            raise ValueError(f"no sweep of {config.benchmark}")
        rows = harness.sweep(spark, config.benchmark, harness.SWEEPS[config.benchmark], config) if asked.sweep else harness.run(spark, config)
        frame = results.result_frame(spark, rows)
        print(results.console(frame))
        if config.output:
            results.write_jsonl(frame, config.output)
        return 2 if config.validate and not all(r["correct"] for r in rows) else 0
    except Exception as e:  # the command line reports every error by its text
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
