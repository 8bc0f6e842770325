"""Command line: clean once, then write the chosen reports as Parquet.

    python -m spineworks.run --source DIR --warehouse DIR --out DIR [--reports a,b] [--fixture]
                             [--format csv [--rejects DIR]]

``--source`` holds the entity tables (the driver's star-schema tables with
``--fixture``, else one Parquet folder per entity table named subscription,
account, feature_usage, support_ticket, churn_event; with ``--format csv`` the
files or folders subscription.csv and so on). ``--warehouse`` and ``--out``
should be shared storage on a cluster. Partition counts follow the input size.
"""

from __future__ import annotations

import argparse

from spineworks.plans.params import FIXTURE_PARAMS, Params
from spineworks.plans.warehouse import WarehouseTables, materialize
from spineworks.plans.registry import QUERIES
from spineworks.plans.tables import Tables
from spineworks.session import build_session, input_bytes, scale_conf
from spineworks.sources.csv import csv_loaders
from spineworks.sources.fixtures import LOADERS
from spineworks.sources.sink import write_table


def _parquet_loaders():
    return {name: (lambda spark, src, n=name: spark.read.parquet(f"{src}/{n}"))
            for name in LOADERS}


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--source", required=True)
    ap.add_argument("--warehouse", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--reports", default="", help="comma-separated names (default: all)")
    ap.add_argument("--fixture", action="store_true", help="derive entities from star-schema tables")
    ap.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    ap.add_argument("--rejects", default="", help="with csv: folder for rows that do not parse (default: they end the job)")
    ap.add_argument("--skip-clean", action="store_true", help="reuse an existing warehouse")
    args = ap.parse_args(argv)
    spark = build_session()
    for key, value in scale_conf(spark.sparkContext.defaultParallelism, input_bytes(spark, args.source)).items():
        spark.conf.set(key, value)
    params = FIXTURE_PARAMS if args.fixture else Params()
    loaders = None if args.fixture else (
        csv_loaders({n: f"{args.source}/{n}.csv" for n in LOADERS}, args.rejects or None) if args.format == "csv" else _parquet_loaders())
    source = Tables(spark, args.source, loaders)
    if not args.skip_clean:
        materialize(source, args.warehouse)
    tables = WarehouseTables(spark, args.warehouse, source)
    names = [n for n in args.reports.split(",") if n] or sorted(QUERIES)
    unknown = [n for n in names if n not in QUERIES]
    if unknown:
        raise SystemExit(f"unknown reports: {', '.join(unknown)}")
    for name in names:
        write_table(QUERIES[name](tables, params), f"{args.out}/{name}")
        print(f"wrote {args.out}/{name}", flush=True)


if __name__ == "__main__":
    main()
