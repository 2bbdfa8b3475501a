"""`python -m planloom`, or spark-submit on this file: runs one plan in the session that the launcher sets up."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from planloom import plan_from_base64, plan_from_file, run_plan


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="planloom", description="Run a batch plan.")
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--plan", metavar="FILE", help="a plan document")
    source.add_argument("--plan-base64", metavar="TEXT", help="a plan document given inline, base64-encoded")
    parser.add_argument("--share", metavar="VIEW", action="append", default=[], help="a view that its targets compute once")
    given = parser.parse_args(arguments)
    plan = plan_from_file(given.plan) if given.plan else plan_from_base64(given.plan_base64)
    run_plan(SparkSession.builder.getOrCreate(), plan, share=given.share)


if __name__ == "__main__":
    main()
