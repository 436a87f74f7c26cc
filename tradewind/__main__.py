"""Run a report as a batch job.

    python -m tradewind REPORT INPUT OUTPUT --as-of "YYYY-MM-DD HH:MM:SS" --params params.json
                        [--format parquet|csv] [--stored] [--store-dir FOLDER]
    python -m tradewind REPORT INPUT OUTPUT --fixture
    python -m tradewind save-roles INPUT OUTPUT [--date-directories [ROLE ...]] [--buckets N]
    python -m tradewind audit INPUT OUTPUT [--stored]
    python -m tradewind show-params

INPUT is a directory of input tables (``<name>.parquet``), or with ``--stored`` a directory written by
``save-roles``.  ``--params`` is a JSON object that names every field of :class:`tradewind.plans.Params` but
the clock; nothing is taken from the test tables.  ``show-params`` prints such an object, with the values of
the test tables, to begin with.  ``--fixture`` takes the parameters and the clock of the test tables
instead.  A report is written as a version beside the last one and becomes current when it is whole; read
it with :func:`tradewind.sources.read_report`.  ``audit`` publishes the values of every role that their typed
reading loses, and prints their counts.  Under ``spark-submit`` the session comes from the submit
configuration.
"""

from __future__ import annotations

import argparse
import dataclasses
import json

from pyspark.sql import SparkSession

from .functions import AsOf
from .plans import FIXTURE, REPORTS, Params, present
from .sources import StoredWarehouse, Warehouse, audit_roles, publish_report, save_roles


def _params(args: argparse.Namespace) -> Params:
    if args.fixture:
        return dataclasses.replace(FIXTURE, as_of=AsOf.of(args.as_of)) if args.as_of else FIXTURE
    with open(args.params) as fh:
        raw = json.load(fh)
    try:
        return Params.from_json(raw, args.as_of)
    except ValueError as e:
        raise SystemExit(f"{args.params}: {e}") from None


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    ap = argparse.ArgumentParser(prog="python -m tradewind")
    ap.add_argument("report", choices=sorted([*REPORTS, "save-roles", "audit", "show-params"]))
    ap.add_argument("input", nargs="?")
    ap.add_argument("output", nargs="?")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--as-of", default=None)
    ap.add_argument("--params", default=None)
    ap.add_argument("--fixture", action="store_true", help="the parameters and clock of the test tables")
    ap.add_argument("--store-dir", default=None, help="shared folder for intermediate tables")
    ap.add_argument("--stored", action="store_true")
    ap.add_argument("--date-directories", nargs="*", metavar="ROLE", help="a directory per date, for all roles or the named ones")
    ap.add_argument("--buckets", type=int, default=None, help="co-partition the roles in so many buckets")
    args = ap.parse_args(argv)
    if args.report == "show-params":
        print(json.dumps(FIXTURE.to_json(), indent=2))
        return
    if not args.input or not args.output:
        ap.error("name the input and the output")
    if args.fixture and args.params:
        ap.error("--fixture and --params exclude each other")
    if args.report not in ("save-roles", "audit") and not args.fixture and not (args.as_of and args.params):
        ap.error("a report needs --as-of and --params (or --fixture for the test tables)")
    params = None if args.report in ("save-roles", "audit") else _params(args)
    spark = spark or SparkSession.builder.appName(f"tradewind-{args.report}").getOrCreate()
    if args.report == "save-roles":
        dated = args.date_directories
        save_roles(Warehouse(spark, args.input), args.output, partition_by_date=False if dated is None else dated or True, buckets=args.buckets)
        return
    if args.stored:
        wh = StoredWarehouse(spark, args.input, store_dir=args.store_dir)
    else:
        wh = Warehouse(spark, args.input, store_dir=args.store_dir)
    if args.report == "audit":
        print(json.dumps(audit_roles(wh, args.output), indent=2))
        return
    publish_report(present(REPORTS[args.report](wh, params)), args.output, fmt=args.format)
    wh.close()


if __name__ == "__main__":
    main()
