"""RF / RFM segmentation, snapshots and their sink (B9, B10, B14-B16, S3, S4)."""

import datetime as dt
import decimal
import re

import pytest
from pyspark.sql import functions as F

from basketlens.functions.profiles import JOURNEY, MARKET, RF_BASIC
from basketlens.operators import (
    paying_users,
    rf_segments,
    rfm_group_counts,
    rfm_scores,
    rfm_snapshots,
    rfm_table,
    segment_revenue_by_month,
    segment_sizes,
    snapshot_users,
    user_rfm,
)
from basketlens.sources import load_table, order_log, read_snapshot, write_snapshots
from tests.conftest import SMALL, orders_df

LAST = dt.date(2020, 12, 31)
CUTOFF = dt.date(2021, 1, 1)

# user -> (days before the last date, orders, money)
BOUNDARY_USERS = {
    "u1": (29, 1, "500"),
    "u2": (30, 2, "500.1"),
    "u3": (59, 10, "1000"),
    "u4": (60, 11, "10000"),
    "u5": (99, 20, "50000"),
    "u6": (100, 21, "50000.1"),
    "u7": (365, 50, "500"),
    "u8": (366, 51, "1000"),
}


def boundary_rows():
    rows = []
    oid = 0
    for user, (days, n, money) in BOUNDARY_USERS.items():
        day = (LAST - dt.timedelta(days=days)).isoformat()
        rest = decimal.Decimal(money) - (n - 1)
        for i in range(n):
            oid += 1
            price = rest if i == n - 1 else decimal.Decimal(1)
            if user == "u2" and i == n - 1:
                # one order id over two rows: counts once
                half = (price / 2).quantize(decimal.Decimal("0.01"))
                rows.append((str(oid), user, str(half), day))
                rows.append((str(oid), user, str(price - half), day))
            else:
                rows.append((str(oid), user, str(price), day))
    rows += [
        ("900", "z", "10", LAST.isoformat()),  # only on the last day: excluded
        ("901", "u1", "99", LAST.isoformat()),  # last day excluded for u1 too
        ("902", "neg", "0", "2020-06-01"),  # no positive price: absent
        ("903", "neg", "-5", "2020-06-02"),
        ("904", "u3", "7", "2021-01-05"),  # after the cutoff
    ]
    return rows


def test_rfm_boundaries(spark):
    o = orders_df(spark, boundary_rows())
    got = {r["user_id"]: r for r in rfm_table(o, CUTOFF, JOURNEY).collect()}
    assert set(got) == set(BOUNDARY_USERS)
    for user, (days, n, money) in BOUNDARY_USERS.items():
        r = got[user]
        assert (r["days"], r["orders"], r["sum_price"]) == (days, n, decimal.Decimal(money))
        rs, fs, ms = JOURNEY.scores(days, n, float(money))
        assert r["rfm_code"] == f"R{rs}-F{fs}-M{ms}"
        assert r["segment"] == JOURNEY.segment_of(f"{rs}{fs}{ms}")
    assert got["u1"]["rfm_code"] == "R5-F1-M1" and got["u1"]["segment"] == "NEW"
    assert got["u4"]["segment"] == "REGULAR"
    assert got["u6"]["rfm_code"] == "R2-F4-M5" and got["u6"]["segment"] == "CHURNED"
    assert got["u8"]["segment"] == "undefined_group"
    # every row carries its group's and code's count
    for r in got.values():
        same_group = sum(1 for x in got.values() if x["segment"] == r["segment"])
        same_code = sum(1 for x in got.values() if x["rfm_code"] == r["rfm_code"])
        assert (r["count_by_group"], r["count_by_rfm"]) == (same_group, same_code)


def test_rfm_share_of_turnover(spark):
    o = orders_df(spark, boundary_rows())
    rows = rfm_table(o, CUTOFF, JOURNEY).collect()
    total = sum(r["sum_price"] for r in rows)
    for r in rows:
        expected = float((r["sum_price"] / total).quantize(decimal.Decimal("0.01"), decimal.ROUND_HALF_UP))
        assert r["share_of_turnover"] == expected
    assert abs(sum(float(r["sum_price"] / total) for r in rows) - 1) < 1e-9


def test_rfm_without_cutoff_keeps_last_day(spark):
    o = orders_df(spark, boundary_rows())
    got = {r["user_id"]: r for r in rfm_table(o, None, MARKET).collect()}
    assert "z" in got and got["z"]["days"] == 5  # last date is the latest order (2021-01-05)
    assert "neg" not in got
    assert {int(r["rfm_code"][1]) for r in got.values()} <= {1, 2, 5}


def test_group_counts_match_paying_users(spark):
    o = orders_df(spark, boundary_rows())
    scored = rfm_scores(o, None, JOURNEY)
    counts = {r["segment"]: r["users"] for r in rfm_group_counts(scored).collect()}
    paying = paying_users(o).collect()[0]["paying_users"]
    assert counts["TOTAL"] == paying == sum(v for k, v in counts.items() if k != "TOTAL")


def test_rf_segments_groups(spark):
    rows = [
        ("1", "a", "5", "2017-04-28"),  # a: 1 order, 2 days -> R3 F1 -> 31 good
        ("2", "b", "5", "2017-03-01"),  # b: 60 days, 1 order -> R1 F1 -> 11 lost (F < 3)
        ("9", "z", "5", "2017-04-30"),  # last date (excluded)
        ("10", "z", "5", "2017-05-02"),  # after the cutoff
    ]
    rows += [(str(100 + i), "c", "1", "2016-01-01") for i in range(25)]  # c: F2, R1 -> 12 undefined
    rows += [(str(200 + i), "d", "1", "2017-04-20") for i in range(3)]  # d: R2 F1, 3 orders -> 21 good
    o = orders_df(spark, rows)
    got = {r["user_id"]: (r["days"], r["orders"], r["rf_code"], r["segment"])
           for r in rf_segments(o, dt.date(2017, 5, 1), RF_BASIC).collect()}
    assert got == {
        "a": (2, 1, "31", "good_regular_users"),
        "b": (60, 1, "11", "lost_users"),
        "c": (485, 25, "12", "undefined_group"),
        "d": (10, 3, "21", "good_regular_users"),
    }


def test_segment_revenue_has_no_fan_out(spark):
    rows = [
        ("1", "a", "10", "2017-01-10"),
        ("2", "a", "20", "2017-02-10"),
        ("3", "a", "30", "2017-03-10"),
        ("4", "b", "5", "2017-03-11"),
        ("5", "z", "1", "2017-04-30"),
    ]
    o = orders_df(spark, rows)
    res = segment_revenue_by_month(o, dt.date(2017, 5, 1), RF_BASIC).collect()
    assert sum(r["sum_price"] for r in res) == decimal.Decimal("65")
    # a: 3 orders, 51 days -> code 11, not below 3 orders -> undefined; b: 1 order -> lost
    assert sorted((r["segment"], r["period"], r["users"]) for r in res) == [
        ("lost_users", "1703", 1),
        ("undefined_group", "1701", 1),
        ("undefined_group", "1702", 1),
        ("undefined_group", "1703", 1),
    ]


def test_snapshots_equal_single_tables(spark):
    o = orders_df(spark, boundary_rows() + [("950", "u9", "70", "2020-11-15"), ("951", "u9", "30", "2020-12-20")])
    cutoffs = [dt.date(2020, 12, 1), dt.date(2020, 12, 25), CUTOFF]
    snaps = rfm_snapshots(o, cutoffs, JOURNEY)
    for c in cutoffs:
        single = sorted(tuple(r) for r in rfm_table(o, c, JOURNEY).collect())
        stacked = sorted(tuple(r)[1:] for r in snaps.where(F.col("snapshot") == F.lit(c)).collect())
        assert single == stacked, c
    sizes = segment_sizes(snaps).groupBy("snapshot").agg(F.sum("count_by_group").alias("n")).orderBy("snapshot")
    totals = [r["n"] for r in sizes.collect()]
    assert totals == sorted(totals)


@pytest.mark.parametrize("k", [20, 100])
def test_many_snapshots_equal_single_tables(spark, k):
    """A hundred cutoffs: the plan keeps its columns and steps, results are those of single tables."""
    orders = order_log(load_table(spark, SMALL, "orders"))
    cutoffs = [dt.date(1995, 1, 20) + dt.timedelta(days=17 * i) for i in range(k)]
    users = snapshot_users(orders, cutoffs)
    found = {}
    for r in users.collect():
        found.setdefault(r.snapshot, set()).add((r.user_id, r.days, r.orders, r.sum_price))
    for c in cutoffs[:: k // 5]:
        single = {(r.user_id, r.days, r.orders, r.sum_price) for r in user_rfm(orders, c).collect()}
        assert found.get(c, set()) == single
    # no column for each cutoff: the plan of 2 has as many operators and columns as that of k
    def shape(df):
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        return [(line.strip(" +-:").split(" ")[0], len(re.findall(r"#\d+", line))) for line in lines]

    assert shape(users) == shape(snapshot_users(orders, cutoffs[:2]))


def test_snapshot_order_spanning_days(spark):
    # one order id on two days; the first day is in every snapshot
    rows = [
        ("1", "a", "10", "2020-01-05"),
        ("1", "a", "20", "2020-02-05"),
        ("2", "a", "5", "2020-02-20"),
        ("3", "z", "1", "2020-01-20"),
        ("4", "z", "1", "2020-02-25"),
    ]
    o = orders_df(spark, rows)
    cutoffs = [dt.date(2020, 2, 1), dt.date(2020, 3, 1)]
    snaps = {(r["snapshot"], r["user_id"]): (r["orders"], r["sum_price"], r["days"])
             for r in rfm_snapshots(o, cutoffs, JOURNEY).collect()}
    assert snaps[(dt.date(2020, 2, 1), "a")] == (1, decimal.Decimal("10"), 15)
    assert snaps[(dt.date(2020, 3, 1), "a")] == (2, decimal.Decimal("35"), 5)


def test_snapshot_sink_and_reader(spark, scratch):
    o = orders_df(spark, boundary_rows())
    path = f"{scratch}/rfm"
    snaps = rfm_snapshots(o, [dt.date(2020, 12, 1), CUTOFF], JOURNEY)
    write_snapshots(snaps, path)
    one = read_snapshot(spark, path, dt.date(2020, 12, 1))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot" in plan
    n_dec = snaps.where(F.col("snapshot") == F.lit(dt.date(2020, 12, 1))).count()
    assert one.count() == n_dec
    # rewrite one snapshot only: the other partition stays
    write_snapshots(rfm_snapshots(o, [CUTOFF], JOURNEY), path)
    assert read_snapshot(spark, path).select("snapshot").distinct().count() == 2
    assert read_snapshot(spark, path, "2020-12-01").count() == n_dec


def test_snapshot_before_all_data_is_empty(spark):
    o = orders_df(spark, boundary_rows())
    cutoffs = ["2000-01-01", "2021-01-01", "2021-01-01"]  # text, repeated, one before every order
    snaps = rfm_snapshots(o, cutoffs, JOURNEY).collect()
    assert {r["snapshot"] for r in snaps} == {CUTOFF}
    single = sorted(tuple(r) for r in rfm_table(o, CUTOFF, JOURNEY).collect())
    assert sorted(tuple(r)[1:] for r in snaps) == single
    assert rfm_table(o, dt.date(2000, 1, 1), JOURNEY).count() == 0


def test_revenue_without_a_user_counts_in_totals(spark):
    from basketlens.functions.profiles import JOURNEY, RF_BASIC
    from basketlens.operators import rfm_snapshots, rfm_table, segment_revenue_by_month
    from tests.conftest import orders_df

    o = orders_df(spark, [("1", "a", "100", "2016-01-01"), ("2", "b", "150", "2016-01-02"), ("3", None, "300", "2016-01-03"), ("4", "a", "1", "2016-02-01")])
    shares = {r["user_id"]: r["share_of_turnover"] for r in rfm_table(o, "2017-01-01", JOURNEY).collect()}
    assert shares == {"a": 0.18, "b": 0.27}
    snaps = {r["user_id"]: r["share_of_turnover"] for r in rfm_snapshots(o, ["2017-01-01"], JOURNEY).collect()}
    assert snaps == shares
    months = [tuple(r) for r in segment_revenue_by_month(o, "2017-01-01", RF_BASIC).collect()]
    assert sorted((m[0] or "", m[1], float(m[2]), m[3]) for m in months)[0] == ("", "1601", 300.0, 0)
