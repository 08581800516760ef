"""Command line: one pipeline run, or an analyst report.

    python -m lakestar run --root ROOT --landing FILE --run-id ID \\
        --processing-date "21-05-2024 18:39:52" --version 1
    python -m lakestar report top-names --root ROOT --version 1 --sex F --year 2019
    python -m lakestar report name-by-year --root ROOT --version 1 --name ABEL
    python -m lakestar report top-names-silver --root ROOT --version 1

``--version`` numbers the runs of a root folder (1 for the first run; run N merges into
the snapshots of run N - 1).  The bucket count of a root is fixed by its first run
(``--buckets``, else sized from the first landing input) and recorded in the root.
"""

from __future__ import annotations

import argparse
import json
import sys

from lakestar.functions.dates import RunContext
from lakestar.operators import maintenance as MT
from lakestar.operators import reports as R
from lakestar.plans import medallion as P
from lakestar.session import get_session


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakestar")
    sub = p.add_subparsers(dest="command", required=True)

    run = sub.add_parser("run", help="landing file -> bronze -> silver -> gold -> mart")
    run.add_argument("--root", required=True, help="folder of the layer tables")
    run.add_argument("--landing", required=True, help="landing CSV file or folder")
    run.add_argument("--run-id", required=True)
    run.add_argument("--processing-date", required=True,
                     help="'dd-MM-yyyy HH:mm:ss' (or 'dd-MM-yyyy')")
    run.add_argument("--version", type=int, required=True)
    run.add_argument("--buckets", type=int, default=None)

    rep = sub.add_parser("report", help="analyst reports over a published mart")
    rep.add_argument("name", choices=["top-names", "name-by-year", "top-names-silver"])
    rep.add_argument("--root", required=True)
    rep.add_argument("--version", type=int, required=True)
    rep.add_argument("--buckets", type=int, default=None)
    rep.add_argument("--sex")
    rep.add_argument("--year", type=int)
    rep.add_argument("--name")
    rep.add_argument("--k", type=int, default=10)
    rep.add_argument("--case-insensitive", action="store_true")
    return p


def main(argv: list[str] | None = None, spark=None) -> list[dict]:
    args = _parser().parse_args(argv)
    spark = spark or get_session()
    if args.command == "run":
        # Buckets grow with the largest landing input seen so far.
        sized = P.buckets_for(spark, MT.input_bytes(spark.read.text(args.landing)))
        layout = P.new_layout(spark, args.root, args.buckets, default_buckets=sized)
    else:
        layout = P.new_layout(spark, args.root, args.buckets)
    if args.command == "run":
        ctx = RunContext.from_params(args.run_id, args.processing_date)
        reports = P.run_all(spark, layout, ctx, args.version, landing_path=args.landing)
        return [{"step": r.step, **r.metrics} for r in reports]
    if args.name == "top-names-silver":
        df = R.top_names_silver(spark, P.read_silver(spark, layout, args.version), args.k)
    else:
        fact = P.read_mart(spark, layout, "fact", args.version)
        names = P.read_mart(spark, layout, "dim_names", args.version)
        years = P.read_mart(spark, layout, "dim_years", args.version)
        if args.name == "top-names":
            df = R.top_names(spark, fact, names, years, args.sex, args.year, args.k,
                             args.case_insensitive)
        else:
            df = R.name_by_year(spark, fact, names, years, args.name, args.case_insensitive)
    return [r.asDict() for r in df.collect()]  # a report: a handful of rows


if __name__ == "__main__":
    for row in main(sys.argv[1:]):
        print(json.dumps(row, default=str))
