"""Incremental daily traffic equals the batch table for every closed day."""

import csv
import decimal
import glob

import pytest

from basketlens.sources.tables import daily_traffic
from basketlens.streaming.traffic import start_daily_traffic
from tests.conftest import SMALL


def test_stream_matches_batch(spark, scratch):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(3).write.parquet(f"{scratch}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{scratch}/in")
    q = start_daily_traffic(stream, f"{scratch}/out", f"{scratch}/ckpt", trigger_available_now=True)
    q.awaitTermination(300)
    got = {r["day"]: r["users"] for r in spark.read.parquet(f"{scratch}/out").collect()}
    expected = {r["day"]: r["users"] for r in daily_traffic(events).collect()}
    assert got, "no closed day emitted"
    assert all(expected[d] == n for d, n in got.items())
    # only the days still open under the watermark (the last one or two) are missing
    assert len(expected) - len(got) <= 2
    assert max(got) < max(expected)


def test_stream_without_a_shared_folder_needs_a_path(spark, scratch, monkeypatch):
    monkeypatch.setattr("pyspark.conf.SparkConf.get", lambda self, key, default=None: default)
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{SMALL}")
    with pytest.raises(ValueError, match="checkpoint"):
        start_daily_traffic(stream, f"{scratch}/out")


def test_snapshot_report_reads_back_stored_table(spark, scratch):
    import datetime as dt

    from basketlens.plans.jobs import snapshot_report
    from basketlens.sources.tables import load_table, order_log

    orders = order_log(load_table(spark, SMALL, "orders"))
    cutoffs = [dt.date(2000, 1, 1), dt.date(2000, 3, 1)]
    sizes = snapshot_report(spark, orders, cutoffs, f"{scratch}/snaps")
    plan = sizes._jdf.queryExecution().optimizedPlan().toString()
    assert "orders.parquet" not in plan  # reads the stored snapshots, not the orders
    per_snapshot = {r["snapshot"]: r["n"] for r in sizes.groupBy("snapshot").agg({"count_by_group": "sum"})
                    .withColumnRenamed("sum(count_by_group)", "n").collect()}
    assert set(per_snapshot) == set(cutoffs)
    assert per_snapshot[cutoffs[0]] <= per_snapshot[cutoffs[1]]


def test_command_line(spark, scratch, capsys):
    from basketlens.__main__ import main
    from basketlens.plans import oracle_sql

    assert main(["list"]) == 0
    assert "rfm_snapshots" in capsys.readouterr().out
    assert main(["sql", "paying_users"]) == 0
    assert capsys.readouterr().out.strip() == oracle_sql()["paying_users"].strip()
    assert main(["run", "nope", "--data", SMALL]) == 2
    out = f"{scratch}/weekday"
    assert main(["run", "traffic_by_weekday", "--data", SMALL, "--out", out, "--master", "local[2]"]) == 0
    assert spark.read.parquet(out).count() == 7
    out = f"{scratch}/rfm"
    assert main(["run", "rfm_journey", "--data", SMALL, "--out", out, "--format", "csv", "--profile", "market", "--sort", "segment", "-sum_price"]) == 0
    rows = [r for part in sorted(glob.glob(f"{out}/part-*")) for r in csv.DictReader(open(part))]
    assert rows == sorted(rows, key=lambda r: (r["segment"], -float(r["sum_price"]))) and len(rows) > 10
    out = f"{scratch}/use"
    assert main(["run", "limit_utilisation", "--data", SMALL, "--out", out, "--threshold", "1000000000"]) == 0
    assert spark.read.parquet(out).count() == 0
    assert main(["run", "most_active_users", "--data", SMALL, "--out", out, "--top", "3"]) == 0
    assert spark.read.parquet(out).count() == 3


def test_command_line_jobs(spark, scratch):
    from basketlens.__main__ import main

    with open(f"{scratch}/orders.csv", "w") as f:
        f.write("id_o;user_id;price;o_date\n1;10;12345678901,5;01.02.2016\n2;11;x;01.02.2016\n3;11;2,5;01.03.2016\n")
    table = f"{scratch}/table"
    for _ in range(2):  # a repeated load changes nothing
        assert main(["ingest", "orders", f"{scratch}/orders.csv", table, "--load", "2016", "--price-type", "decimal(12,1)"]) == 0
    good = spark.read.parquet(table).where("status = 'good'")
    assert sorted(r.price for r in good.collect()) == [2.5, decimal.Decimal("12345678901.5")]
    snaps = f"{scratch}/snaps"
    assert main(["snapshots", "--data", SMALL, "--out", snaps, "--snapshots", "2000-01-01", "2000-02-01", "--sort", "user_id"]) == 0
    assert spark.read.parquet(snaps).select("snapshot").distinct().count() == 2


def test_stream_days_in_another_session_zone(scratch):
    """The streaming days are the stored calendar days in any session zone
    (run in a separate process: the shared test session stays in UTC)."""
    import os
    import subprocess
    import sys
    import textwrap

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {root!r})
        from pyspark.sql import SparkSession
        from basketlens.sources.tables import daily_traffic
        from basketlens.streaming.traffic import start_daily_traffic
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
                 .config("spark.sql.session.timeZone", "America/Los_Angeles").getOrCreate())
        ev = spark.read.parquet({SMALL!r} + "/events.parquet")
        ev.repartition(2).write.parquet({scratch!r} + "/in")
        q = start_daily_traffic(spark.readStream.schema(ev.schema).parquet({scratch!r} + "/in"),
                                {scratch!r} + "/out", {scratch!r} + "/ckpt", trigger_available_now=True)
        q.awaitTermination(300)
        got = {{r["day"]: r["users"] for r in spark.read.parquet({scratch!r} + "/out").collect()}}
        exp = {{r["day"]: r["users"] for r in daily_traffic(ev).collect()}}
        print("OK" if got and all(exp.get(k) == v for k, v in got.items()) else "MISMATCH")
    """)
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=600)
    assert out.stdout.strip().endswith("OK"), out.stdout[-2000:] + out.stderr[-2000:]
