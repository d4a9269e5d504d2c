"""Cohorts, active users and recent frequent buyers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.bounds import bounded_broadcast
from basketlens.functions.calendar import as_date, period_label, within
from basketlens.functions.numeric import round_money, safe_ratio
from basketlens.operators.segments import analysed_rows, last_order_date

DateLike = dt.date | str


def user_cohorts(orders: DataFrame, cutoff: DateLike | None = None) -> DataFrame:
    """First-purchase month per user: ``user_id, cohort`` (``yyMM``), over
    rows strictly before the last order date before ``cutoff``."""
    last = last_order_date(orders, cutoff)
    rows = analysed_rows(orders.where(F.col("user_id").isNotNull()), cutoff, last)
    return rows.groupBy("user_id").agg(period_label(F.min("o_date")).alias("cohort"))


def cohort_revenue(orders: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Revenue per cohort and month: ``cohort, period, sum_price``.

    Orders are first summed per (user, month), so the join with the
    one-row-per-user cohorts sees at most one row per user and month,
    however many orders a single user has.
    """
    monthly = (
        orders.where(F.col("user_id").isNotNull())
        .groupBy("user_id", period_label("o_date").alias("period"))
        .agg(F.sum("price").alias("sum_price"))
    )
    return (
        monthly.join(cohorts.select("user_id", "cohort"), "user_id", "inner")
        .groupBy("cohort", "period")
        .agg(F.sum("sum_price").alias("sum_price"))
    )


def cohort_revenue_by_cutoff(orders: DataFrame, cutoff: DateLike | None = None) -> DataFrame:
    """:func:`cohort_revenue` with the cohorts of :func:`user_cohorts`, in
    one pass over the orders and without a join.

    The monthly sums per user also carry each user-month's first order day
    before the last date; a window over the user's months (partitioned by
    ``user_id``: many small partitions, at most one row per month for even
    the heaviest user) gives every user-month the user's cohort.
    """
    before = F.col("o_date") < last_order_date(orders, cutoff) if cutoff is not None else F.lit(True)
    monthly = (
        orders.where(F.col("user_id").isNotNull())
        .groupBy("user_id", period_label("o_date").alias("period"))
        .agg(
            F.sum("price").alias("sum_price"),
            F.min(F.when(before, F.col("o_date"))).alias("first_before"),
        )
    )
    first_day = F.min("first_before").over(Window.partitionBy("user_id"))
    return (
        monthly.select("period", "sum_price", first_day.alias("first_day"))
        .where(F.col("first_day").isNotNull())
        .groupBy(period_label("first_day").alias("cohort"), "period")
        .agg(F.sum("sum_price").alias("sum_price"))
    )


def active_users(
    orders: DataFrame,
    since: DateLike | Column | None = None,
    before: DateLike | Column | None = None,
) -> DataFrame:
    """Distinct users with an order on/after ``since`` and/or before
    ``before`` (dates or scalar columns such as :func:`last_order_date`)."""
    wanted = F.col("user_id").isNotNull() & within(orders, since, before)
    return orders.where(wanted).select("user_id").distinct()


FILTER_BITS = 1 << 20  # of the membership filter of frequent_recent_buyers


def frequent_recent_buyers(
    orders: DataFrame,
    last_date: DateLike | Column,
    window_days: int = 30,
    min_rows: int = 3,
    cutoff: DateLike | None = None,
) -> DataFrame:
    """Users who bought before ``last_date`` and have more than ``min_rows``
    order rows in the ``window_days`` days up to it
    (``0 <= last_date - o_date < window_days``):
    ``user_id, frequency`` (distinct orders / distinct order days, 2 places),
    ``first_date`` (first order day in the window), ``order_rows``.

    Only rows of the window are aggregated, once.  A user with a window row
    before ``last_date`` has bought before; *open* are those whose window rows
    all fall on that day.  Open users make a membership filter (one hash bit
    each, of ``FILTER_BITS``, in words of 64 that are broadcast), the history
    is read through it, and only the users that pass are shuffled and joined.

    Bounds that are literals reach the scan: a ``last_date`` given as a date,
    and ``cutoff``, a date known to lie after a ``last_date`` that is a column.
    """
    last = as_date(last_date)
    from_day = F.date_sub(last, window_days)
    known = orders.where(F.col("user_id").isNotNull())
    if cutoff is not None:
        known = known.where(within(known, before=cutoff))
    per_user = (
        known.where(within(known, F.date_add(from_day, 1), F.date_add(last, 1)))
        .groupBy("user_id")
        .agg(
            F.min("o_date").alias("first_date"),
            F.count(F.lit(1)).alias("order_rows"),
            F.count_distinct("id_o").alias("window_orders"),
            F.collect_set("o_date").alias("days"),  # at most window_days
        )
        .where(F.col("order_rows") > min_rows)
    )
    # bit operations are never NULL, so no test for it is pushed into one of the branches
    bit = F.xxhash64("user_id").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    word, place = F.shiftright(bit, 6), bit.bitwiseAND(F.lit(63).cast("long")).cast("int")
    # reads all that per_user has, so that both branches share its aggregate
    unknown = (F.col("first_date") >= last) & (F.col("window_orders") >= 0) & (F.size("days") > 0)
    words = (
        per_user.where(unknown)
        .groupBy(word.alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("bits"))
    )
    earlier = (
        known.where(within(known, before=F.date_add(from_day, 1)))
        .select("user_id", word.alias("word"))
        .join(bounded_broadcast(words, FILTER_BITS // 64), "word")
        .where(F.bit_get("bits", place) == 1)
        .select("user_id", F.lit(True).alias("earlier"))
        .distinct()
    )
    found = per_user.join(earlier, "user_id", "left").where((F.col("first_date") < last) | F.col("earlier"))
    return found.select(
        "user_id",
        round_money(safe_ratio("window_orders", F.size("days"))).alias("frequency"),
        "first_date",
        "order_rows",
    )
