"""Command line: run a registered analysis or a job over a folder of tables.

    python -m basketlens list
    python -m basketlens run rfm_journey --data /path/to/tables [--show 20]
    python -m basketlens run rfm_snapshots --data /path --out /path/rfm --format parquet
    python -m basketlens run churned_users --data /path --year 2016
    python -m basketlens run rfm_journey --data /path --profile market --sort segment -sum_price
    python -m basketlens ingest orders export.csv /path/table --load 2016-02
    python -m basketlens snapshots --data /path --out /path/rfm --snapshots 2000-01-01 2000-02-01
    python -m basketlens sql rfm_journey

``sql`` prints the text for the parameters of ``plans.params``.  ``--master``
defaults to ``local[*]``; pass ``--master none`` under ``spark-submit`` (the
cluster then decides, with ``CLUSTER_CONF``).
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import SparkSession


def _falling(argv: list[str]) -> list[str]:
    """``--sort -column`` as the parser takes it (a leading - would be an option)."""
    out, sorting = [], False
    for a in argv:
        sorting = (sorting and not a.startswith("--")) or a == "--sort"
        out.append(f" {a}" if sorting and a.startswith("-") and a != "--sort" else a)
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="basketlens")
    sub = parser.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="names of the registered analyses")
    run = sub.add_parser("run", help="run one analysis")
    run.add_argument("name")
    run.add_argument("--data", required=True, help="folder with <table>.parquet")
    run.add_argument("--out", help="write the result here instead of showing it")
    run.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    run.add_argument("--show", type=int, default=20, help="rows to show when not writing")
    run.add_argument("--cutoff", type=dt.date.fromisoformat, help="cutoff of RFM, RF and cohort analyses (YYYY-MM-DD)")
    run.add_argument("--snapshots", type=dt.date.fromisoformat, nargs="+", help="cutoffs of the snapshots")
    run.add_argument("--year", type=int, help="year of churn, traffic and channel analyses (growth: against the year before)")
    run.add_argument("--window-days", type=int, help="window of frequent recent buyers")
    run.add_argument("--min-rows", type=int, help="order rows a frequent recent buyer has more of")
    run.add_argument("--threshold", type=int, help="use of the limit in percent")
    run.add_argument("--top", type=int, help="number of users or channels of the top lists")
    ingest = sub.add_parser("ingest", help="store an export as a typed table with its quarantine")
    ingest.add_argument("kind", choices=["orders", "traffic"])
    ingest.add_argument("src")
    ingest.add_argument("dest")
    ingest.add_argument("--load", help="name of the export: replaces this load only, a repeated one changes nothing")
    ingest.add_argument("--price-type", default="decimal(10,1)")
    snaps = sub.add_parser("snapshots", help="store RFM snapshots, show the segment sizes")
    snaps.add_argument("--data", required=True)
    snaps.add_argument("--out", required=True)
    snaps.add_argument("--snapshots", type=dt.date.fromisoformat, nargs="+", required=True)
    for p in (run, snaps):
        p.add_argument("--profile", choices=["journey", "market", "journey_scaled"], help="scores and segments of the RFM analyses")
        p.add_argument("--sort", nargs="+", default=[], help="order of the result: columns, -column for falling")
    for p in (run, ingest, snaps):
        p.add_argument("--master", default="local[*]")
        p.add_argument("--partitions", type=int, default=8)
    sql = sub.add_parser("sql", help="print the equivalent SQL of one analysis")
    sql.add_argument("name")
    args = parser.parse_args(_falling(sys.argv[1:] if argv is None else argv))

    from basketlens.plans import oracle_sql, queries

    catalog = queries()
    if args.cmd == "list":
        print("\n".join(catalog))
        return 0
    if args.cmd in ("run", "sql") and args.name not in catalog:
        print(f"unknown analysis {args.name!r}; see `python -m basketlens list`", file=sys.stderr)
        return 2
    if args.cmd == "sql":
        print(oracle_sql().get(args.name, "-- no SQL form"))
        return 0

    from basketlens.session import CLUSTER_CONF, build_session

    master = None if args.master.lower() == "none" else args.master
    spark = build_session(master, args.partitions, extra_conf=None if master else CLUSTER_CONF)
    return {"run": _run, "ingest": _ingest, "snapshots": _snapshots}[args.cmd](spark, args)


def _profile(args: argparse.Namespace):
    from basketlens.functions.profiles import JOURNEY, MARKET
    from basketlens.plans import params

    return {"journey": JOURNEY, "market": MARKET, "journey_scaled": params.JOURNEY_SCALED}[args.profile or "journey"]


def _run(spark: SparkSession, args: argparse.Namespace) -> int:
    from basketlens.plans import params, queries
    from basketlens.sources.sorting import in_order

    given = {
        ("RFM_CUTOFF", "RF_CUTOFF", "COHORT_CUTOFF"): args.cutoff,
        ("SNAPSHOT_CUTOFFS",): tuple(args.snapshots or ()),
        ("CHURN_YEAR", "TRAFFIC_YEAR", "CHANNEL_YEAR"): args.year,
        ("CHANNEL_PREV_YEAR",): args.year and args.year - 1,
        ("RECENT_WINDOW_DAYS",): args.window_days,
        ("RECENT_MIN_ROWS",): args.min_rows,
        ("LIMIT_THRESHOLD",): args.threshold,
        ("TOP_USERS", "TOP_CHANNELS"): args.top,
        ("JOURNEY", "MARKET", "JOURNEY_SCALED"): args.profile and _profile(args),
    }
    values = {name: value for names, value in given.items() if value not in (None, ()) for name in names}
    before = {name: getattr(params, name) for name in values}
    try:
        for name, value in values.items():
            setattr(params, name, value)
        df = queries()[args.name](spark, args.data)
    finally:
        for name, value in before.items():
            setattr(params, name, value)
    if args.sort:
        df = in_order(df, *(k.strip() for k in args.sort))
    if args.out:
        writer = df.write.mode("overwrite")
        if args.format == "csv":
            writer = writer.option("header", True)
        writer.format(args.format).save(args.out)
        print(f"wrote {args.name} to {args.out}")
    else:
        df.show(args.show, truncate=False)
    return 0


def _ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    from basketlens.sources.ingest import ingest_daily_traffic_table, ingest_orders_table

    if args.kind == "orders":
        found = ingest_orders_table(spark, args.src, args.dest, price_type=args.price_type, load=args.load)
    else:
        found = ingest_daily_traffic_table(spark, args.src, args.dest, load=args.load)
    print(f"{args.dest}: {found.good.count()} good rows, {found.rejected.count()} rejected")
    return 0


def _snapshots(spark: SparkSession, args: argparse.Namespace) -> int:
    from basketlens.plans.jobs import snapshot_report
    from basketlens.sources.tables import load_table, order_log

    orders = order_log(load_table(spark, args.data, "orders"))
    sizes = snapshot_report(spark, orders, args.snapshots, args.out, _profile(args), sort=[k.strip() for k in args.sort])
    sizes.orderBy("snapshot", "segment").show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
