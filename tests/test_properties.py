"""Randomised checks: the one-pass plans against brute force on small logs."""

import datetime as dt
import decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketlens.functions.profiles import JOURNEY
from basketlens.operators import churned_users, rfm_snapshots, rfm_table
from tests.conftest import orders_df

BASE = dt.date(2020, 1, 1)

order_rows = st.lists(
    st.tuples(
        st.integers(0, 40),  # order id (ids repeat: an order may span rows and days)
        st.sampled_from(["a", "b", "c", "hot", "hot", "hot", None]),
        st.integers(-2, 900),  # price in cents / 10
        st.integers(0, 120),  # day offset
    ),
    min_size=1,
    max_size=60,
)


def _frame(spark, rows):
    return orders_df(
        spark,
        [(str(o), u, str(decimal.Decimal(p) / 10), (BASE + dt.timedelta(days=d)).isoformat()) for o, u, p, d in rows],
    )


def _brute_rfm(rows, cutoff):
    dates = [BASE + dt.timedelta(days=d) for _, _, _, d in rows]
    before = [d for d in dates if d < cutoff]
    if not before:
        return {}
    last = max(before)
    users = {}
    for (o, u, p, d), day in zip(rows, dates):
        if u is None or p <= 0 or day >= last:
            continue
        mx, ids, total = users.get(u, (None, set(), decimal.Decimal(0)))
        users[u] = (day if mx is None or day > mx else mx, ids | {o}, total + decimal.Decimal(p) / 10)
    return {u: ((last - mx).days, len(ids), total) for u, (mx, ids, total) in users.items()}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=order_rows, cut_days=st.lists(st.integers(1, 125), min_size=1, max_size=3, unique=True))
def test_snapshots_match_single_tables_and_brute_force(spark, rows, cut_days):
    o = _frame(spark, rows)
    cutoffs = sorted(BASE + dt.timedelta(days=c) for c in cut_days)
    snaps = rfm_snapshots(o, cutoffs, JOURNEY).collect()
    for c in cutoffs:
        stacked = {r["user_id"]: (r["days"], r["orders"], r["sum_price"]) for r in snaps if r["snapshot"] == c}
        single = {r["user_id"]: (r["days"], r["orders"], r["sum_price"]) for r in rfm_table(o, c, JOURNEY).collect()}
        assert stacked == single == _brute_rfm(rows, c)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=order_rows)
def test_churn_matches_set_difference(spark, rows):
    # spread the offsets over two years
    two_years = [(o, u, p, d * 6) for o, u, p, d in rows]
    o = _frame(spark, two_years)
    got = {r["user_id"] for r in churned_users(o, 2020).collect()}
    first = {u for _, u, _, d in two_years if u is not None and (BASE + dt.timedelta(days=d)).year == 2020}
    second = {u for _, u, _, d in two_years if u is not None and (BASE + dt.timedelta(days=d)).year == 2021}
    assert got == first - second


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=order_rows)
def test_group_counts_are_consistent(spark, rows):
    o = _frame(spark, rows)
    table = rfm_table(o, None, JOURNEY).collect()
    by_group = {}
    for r in table:
        by_group[r["segment"]] = by_group.get(r["segment"], 0) + 1
    assert all(r["count_by_group"] == by_group[r["segment"]] for r in table)
    assert len({r["user_id"] for r in table}) == len(table)
    paying = o.where((F.col("price") > 0) & F.col("user_id").isNotNull()).select("user_id").distinct().count()
    assert len(table) == paying
