"""python -m pairloom FILE [--greedy | --greedy-md] [--kind KIND] [--strategy STRATEGY]: the largest matching of a graph file."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.matching import STRATEGIES
from .plans.console import run_file


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="pairloom", description="The largest matching of a graph file, with its report; the exit code is 1 if the validation fails.")
    p.add_argument("file")
    start = p.add_mutually_exclusive_group()
    start.add_argument("--greedy", dest="init", action="store_const", const="greedy", default="none", help="start from the first-fit matching")
    start.add_argument("--greedy-md", dest="init", action="store_const", const="greedy-md", help="start from the least-degree matching")
    p.add_argument("--kind", choices=("general", "bipartite", "mtx"), default="general")
    p.add_argument("--strategy", choices=(*(s for s in STRATEGIES if s != "layered"), "rounds"), default="phased", help="of general graphs; rounds: over the whole graph, in either kind")
    a = p.parse_args(args)
    lines, passed = run_file(spark or SparkSession.builder.appName("pairloom").getOrCreate(), a.file, a.kind, a.init, a.strategy)
    print("\n".join(lines))
    return 0 if passed else 1


if __name__ == "__main__":
    sys.exit(main())
