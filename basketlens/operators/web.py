"""Web traffic and channel analytics.

Inputs: daily traffic ``(day, users)``, channel visits
``(channel, year, user_id)`` and channel sales
``(channel, year, user_id, revenue)`` (see ``sources.tables``).  Every
result is first reduced to one row per day or channel, so the final
steps (maximum, shares, top-k) work on frames bounded by the calendar or
by the number of channels.  The ``year`` arguments filter a derived
column; build the inputs with ``channel_visits(events, years)`` /
``channel_sales(orders, customer, years)`` so the bound also reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.calendar import weekday_name
from basketlens.functions.numeric import round_money, safe_ratio


def peak_traffic_days(daily: DataFrame) -> DataFrame:
    """Day(s) with the most users and their weekday: ``dayname, day, users``.
    Every day equal to the maximum is kept (ties are not cut)."""
    peak = daily.agg(F.max("users")).scalar()
    return daily.where(F.col("users") == peak).select(
        weekday_name("day").alias("dayname"), "day", "users"
    )


def traffic_by_weekday(daily: DataFrame) -> DataFrame:
    """Total users per weekday: ``dayname, users, days``."""
    return daily.groupBy(weekday_name("day").alias("dayname")).agg(
        F.sum("users").alias("users"), F.count(F.lit(1)).alias("days")
    )


def top_channels(visits: DataFrame, k: int = 3, year: int | None = None) -> DataFrame:
    """Top ``k`` channels by distinct users (ties by channel name):
    ``channel, users``."""
    src = visits if year is None else visits.where(F.col("year") == year)
    return (
        src.where(F.col("user_id").isNotNull())
        .groupBy("channel")
        .agg(F.count_distinct("user_id").alias("users"))
        .orderBy(F.col("users").desc(), F.col("channel").asc())
        .limit(k)
    )


def channel_revenue_share(sales: DataFrame, year: int | None = None, k: int = 3) -> DataFrame:
    """Top ``k`` channels by revenue with their share of all revenue in %:
    ``channel, revenue, share_pct`` (shares of all channels sum to 100)."""
    src = sales if year is None else sales.where(F.col("year") == year)
    per_channel = src.groupBy("channel").agg(F.sum("revenue").alias("revenue"))
    total = per_channel.agg(F.sum("revenue")).scalar()
    return (
        per_channel.select(
            "channel", "revenue", round_money(safe_ratio(F.col("revenue"), total) * 100).alias("share_pct")
        )
        .orderBy(F.col("revenue").desc(), F.col("channel").asc())
        .limit(k)
    )


def channel_growth(visits: DataFrame, year: int, prev_year: int | None = None, k: int = 1) -> DataFrame:
    """Channel(s) with the greatest growth of distinct users against the
    previous year, in %: ``channel, users, prev_users, growth_pct``.
    No users in the previous year gives NULL growth, ranked last.

    Each user of a channel gets a flag per year, and the flags are counted:
    no self join, and no row is repeated for a distinct count.
    """
    prev = year - 1 if prev_year is None else prev_year
    flags = (
        visits.where(F.col("year").isin(year, prev) & F.col("user_id").isNotNull())
        .groupBy("channel", "user_id")
        .agg(F.bool_or(F.col("year") == year).alias("now"), F.bool_or(F.col("year") == prev).alias("then"))
    )
    per_channel = flags.groupBy("channel").agg(F.count_if("now").alias("users"), F.count_if("then").alias("prev_users"))
    growth = round_money(safe_ratio(F.col("users") - F.col("prev_users"), F.col("prev_users")) * 100)
    return (
        per_channel.select("channel", "users", "prev_users", growth.alias("growth_pct"))
        .orderBy(F.col("growth_pct").desc_nulls_last(), F.col("channel").asc())
        .limit(k)
    )
