"""The order log by month, files in order, joins with hot keys, merged sketches."""

import datetime as dt
import glob
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from basketlens import operators as ops
from basketlens.functions.hot_keys import heavy_hitters, spread_join
from basketlens.functions.profiles import JOURNEY
from basketlens.sources import in_order, load_table, order_log, read_order_log, write_order_log, write_snapshots
from tests.conftest import MEDIUM, SMALL, orders_df

CUTOFF = dt.date(1997, 3, 10)


@pytest.fixture(scope="module")
def months(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orders") / "log")
    write_order_log(order_log(load_table(spark, MEDIUM, "orders")), path)
    return path


def listed(df):
    """Months that the scans of a frame listed, by the metric of each scan."""
    df.collect()
    jvm, found = df.sparkSession._jvm, []

    def walk(plan):
        if plan.nodeName().startswith("Scan parquet"):
            metrics = plan.metrics()
            found.append((metrics.apply("numPartitions").value(), metrics.apply("numFiles").value()))
        if plan.nodeName() == "AdaptiveSparkPlan":
            walk(plan.executedPlan())
        if "QueryStage" in plan.nodeName():
            walk(plan.plan())
        for group in (plan.children(), plan.subqueries()):
            for i in range(group.size()):
                walk(group.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    assert jvm is not None and found
    return found


def test_stored_months_hold_the_same_orders(spark, months):
    whole, stored = order_log(load_table(spark, MEDIUM, "orders")), read_order_log(spark, months)
    assert stored.columns == ["id_o", "user_id", "price", "o_date", "o_month"]
    assert stored.drop("o_month").exceptAll(whole).isEmpty() and whole.exceptAll(stored.drop("o_month")).isEmpty()
    assert stored.where("o_month != trunc(o_date, 'MM')").isEmpty()


def test_only_the_months_of_a_cutoff_are_listed(spark, months):
    stored, whole = read_order_log(spark, months), order_log(load_table(spark, MEDIUM, "orders"))
    n = {r.y: r.n for r in stored.groupBy(F.year("o_month").alias("y")).agg(F.count_distinct("o_month").alias("n")).collect()}
    before = stored.where(F.col("o_month") < F.lit(CUTOFF)).select("o_month").distinct().count()
    cases = {
        "churned_users": (lambda o: ops.churned_users(o, 1996), n[1996] + n[1997]),
        "rfm_journey": (lambda o: ops.rfm_table(o, CUTOFF, JOURNEY), before),
        "rfm_snapshots": (lambda o: ops.rfm_snapshots(o, [dt.date(1996, 7, 1), CUTOFF], JOURNEY), before),
        "segment_revenue": (lambda o: ops.segment_revenue_by_month(o, CUTOFF), before),
        # the bound is a scalar subquery: months are pruned when the last date is known
        "active_users": (lambda o: ops.active_users(o, since=ops.last_order_date(o, CUTOFF), before=CUTOFF), before),
    }
    for name, (run, most) in cases.items():
        df = run(stored)
        scans = listed(df)
        assert max(k for k, _ in scans) == most < sum(n.values()), (name, scans)
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        assert re.search(r"PartitionFilters: \[.*o_month", text), name
        assert sorted(map(str, df.collect())) == sorted(map(str, run(whole).collect())), name
    assert min(k for k, _ in listed(cases["active_users"][0](stored))) == 1
    window = ops.frequent_recent_buyers(stored, ops.last_order_date(stored, CUTOFF), 40, 1, cutoff=CUTOFF)
    assert min(k for k, _ in listed(window)) <= 3
    assert sorted(map(str, window.collect())) == sorted(map(str, ops.frequent_recent_buyers(whole, ops.last_order_date(whole, CUTOFF), 40, 1).collect()))


def test_months_are_replaced_and_rows_without_a_date_stay(spark, scratch):
    path = f"{scratch}/log"
    first = orders_df(spark, [("1", "a", "1", "2020-01-05"), ("2", "a", "2", "2020-02-05"), ("3", "b", "3", None)])
    write_order_log(first, path)
    again = orders_df(spark, [("4", "c", "4", "2020-02-07")])
    for _ in range(2):
        write_order_log(again, path)
    assert sorted(r.id_o for r in read_order_log(spark, path).collect()) == ["1", "3", "4"]


def test_files_are_in_order(spark, scratch, months):
    rows = spark.range(20000).select((F.col("id") * 7919 % 20011).alias("k"), (F.col("id") % 5).alias("g"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        in_order(rows, "-g", "k").write.parquet(f"{scratch}/sorted")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted(glob.glob(f"{scratch}/sorted/part-*"))
    got = [(r["g"], r["k"]) for p in parts for r in pq.read_table(p).to_pylist()]
    assert len(parts) > 1 and got == sorted(got, key=lambda x: (-x[0], x[1]))
    write_snapshots(rows.withColumnRenamed("g", "snapshot"), f"{scratch}/snaps", sort=["k"])
    for g in range(5):
        got = [r["k"] for p in sorted(glob.glob(f"{scratch}/snaps/snapshot={g}/*.parquet")) for r in pq.ParquetFile(p).read().to_pylist()]
        assert len(got) == 4000 and got == sorted(got)
    day = sorted(glob.glob(f"{months}/o_month=1996-05-01/*.parquet"))
    got = [r["o_date"] for p in day for r in pq.ParquetFile(p).read().to_pylist()]
    assert got == sorted(got)
    with pytest.raises(ValueError):
        in_order(rows)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_the_plain_join(spark, how):
    n = 30000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 900).alias("k"), (F.col("id") % 11).alias("v")
    )
    lookup = spark.range(600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    lookup = lookup.union(lookup.where("k in (7, 8)"))  # keys that occur twice
    got, want = spread_join(rows, lookup, "k", how), rows.join(lookup, "k", how)
    assert got.columns == want.columns
    assert got.groupBy(*got.columns).count().exceptAll(want.groupBy(*want.columns).count()).isEmpty() and got.count() == want.count()
    assert [r.k for r in heavy_hitters(rows, "k", 0.01).collect()] == [7]
    assert spread_join(rows, lookup, "k", how, salts=1).count() == want.count()
    assert spread_join(rows.limit(0), lookup, "k", how).count() == 0


def test_a_hot_client_is_spread_without_adaptive_execution(spark):
    n = 60000
    tx = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000).alias("id_client"), F.lit(80).cast("decimal(12,2)").alias("transaction_sum")
    )
    clients = spark.range(5000).select(F.col("id").alias("id_client"), F.lit(100).cast("decimal(12,2)").alias("limit_sum"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        used = ops.limit_utilisation(clients, tx.repartition(4), 70)
        sizes = [r["count"] for r in used.groupBy(F.spark_partition_id()).count().collect()]
        plain = ops.limit_utilisation(clients, tx.repartition(4), 70, salts=1)
        hot = max(r["count"] for r in plain.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == n and hot > n / 3 and max(sizes) < n / 5


def test_merged_sketches_keep_their_bound(spark, scratch):
    visits = spark.range(400000).select(
        F.date_add(F.lit(dt.date(2023, 12, 20)), (F.col("id") % 40).cast("int")).alias("day"),
        (F.xxhash64("id") % 60000).alias("user_id"), F.when(F.col("id") % 7 == 0, "a").otherwise("b").alias("channel"),
    )
    visits = visits.union(spark.createDataFrame([(None, 1, "a"), (dt.date(2024, 1, 1), None, "c")], "day date, user_id long, channel string"))
    path = f"{scratch}/sketches"
    ops.write_sketches(ops.daily_sketches(visits, ["channel"]), path)
    stored = ops.read_sketches(spark, path)
    assert stored.count() == 80
    lo, hi = dt.date(2023, 12, 25), dt.date(2024, 1, 20)
    near = visits.where((F.col("day") >= F.lit(lo)) & (F.col("day") < F.lit(hi)))
    for by, want in (([], near), (["channel"], near), ([F.year("day").alias("year"), "channel"], near)):
        exact = {tuple(r)[:-1]: r[-1] for r in want.groupBy(*by).agg(F.count_distinct("user_id").alias("n")).collect()}
        got = {tuple(r)[:-1]: r.users for r in ops.merged_users(stored, by, lo, hi).collect()}
        exact.pop(("c",), None), exact.pop((2024, "c"), None)  # no known user: no sketch
        assert got.keys() == exact.keys()
        assert all(abs(got[k] - exact[k]) <= ops.sketch_bound() * exact[k] for k in exact)
    df = ops.merged_users(stored, [], lo, dt.date(2024, 1, 1))
    assert [k for k, _ in listed(df)] == [1]  # December alone
    assert ops.merged_users(stored, [], dt.date(2030, 1, 1)).first().users == 0
    small = ops.daily_sketches(load_table(spark, SMALL, "events").select("user_id", F.col("ts").cast("date").alias("day")))
    assert ops.merged_users(small).first().users == load_table(spark, SMALL, "events").select("user_id").distinct().count()
