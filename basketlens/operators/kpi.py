"""Order KPIs: period, volume, average check, orders per user, churn,
most active users, seasonality.

Input everywhere is the order log ``O(id_o, user_id, price, o_date)``.
"""

from __future__ import annotations

from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.calendar import days_between, within_years, year_range
from basketlens.functions.numeric import round_decimal, round_money, safe_ratio
from basketlens.functions.bounds import MAX_CALENDAR_YEARS, bounded_broadcast


def order_period(orders: DataFrame) -> DataFrame:
    """First and last order date and the days between them (one row)."""
    return orders.agg(
        F.min("o_date").alias("period_from"), F.max("o_date").alias("period_to")
    ).select("period_from", "period_to", days_between("period_to", "period_from").alias("period_days"))


def order_period_rows(orders: DataFrame) -> DataFrame:
    """The same period as rows ``period_from_to``: first and last date, one
    row when they are equal (a distinct union of the two), none when empty.

    One aggregation, then the two values are exploded: no second scan.
    """
    bounds = orders.agg(F.min("o_date").alias("lo"), F.max("o_date").alias("hi"))
    return (
        bounds.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("period_from_to"))
        .where(F.col("period_from_to").isNotNull())
    )


def order_volume(orders: DataFrame) -> DataFrame:
    """Rows, distinct order ids and distinct users.

    Each distinct count reads its own column; both in one aggregate would
    repeat every row per counted column.
    """
    users = orders.agg(F.count_distinct("user_id").alias("users")).scalar()
    volume = orders.agg(F.count(F.lit(1)).alias("number_rows"), F.count_distinct("id_o").alias("unique_order_ids"))
    return volume.select("number_rows", "unique_order_ids", users.alias("unique_user_ids"))


def average_check(orders: DataFrame, level: Literal["row", "order"] = "order") -> DataFrame:
    """Average check per year and month.

    ``level='row'``: mean price of the rows of the month (column ``average``).
    ``level='order'``: each order's check is the mean price of its rows,
    rounded to 2 places, dated by its first row; the month's value is the mean
    of those checks (column ``average_check``, 2 places).  An order whose rows fall in
    two months counts in the month of its first row.
    """
    if level == "row":
        return (
            orders.groupBy(F.year("o_date").alias("year"), F.month("o_date").alias("month"))
            .agg(safe_ratio(F.sum("price"), F.count("price")).alias("average"))
        )
    checks = orders.groupBy("id_o").agg(
        F.min("o_date").alias("o_date"),
        round_decimal(safe_ratio(F.sum("price"), F.count("price"))).alias("check"),
    )
    return checks.groupBy(F.year("o_date").alias("year"), F.month("o_date").alias("month")).agg(
        round_money(safe_ratio(F.sum("check"), F.count("check"))).alias("average_check")
    )


def orders_per_user(orders: DataFrame, by: Literal["year", "month"] = "year") -> DataFrame:
    """Mean number of order rows per active user, per year (or year and month).

    Rows are counted per (user, year[, month]) first, then averaged over the
    users active in that period; rows without a user are left out.
    """
    dated = orders.where(F.col("user_id").isNotNull()).withColumn("year", F.year("o_date"))
    keys = ["year"]
    if by == "month":
        dated = dated.withColumn("month", F.month("o_date"))
        keys.append("month")
    per_user = dated.groupBy("user_id", *keys).agg(F.count(F.lit(1)).alias("cnt"))
    return per_user.groupBy(*keys).agg(
        safe_ratio(F.sum("cnt"), F.count("cnt")).alias("average_orders")
    )


def _year_flags(orders: DataFrame, year: int, next_year: int) -> DataFrame:
    """Per user: bought in ``year``? bought in ``next_year``?  One scan of the
    two years (range filters reach the scan), one shuffle."""
    in_year = year_range("o_date", year)
    in_next = year_range("o_date", next_year)
    return (
        orders.where(F.col("user_id").isNotNull() & within_years(orders, year, next_year))
        .groupBy("user_id")
        .agg(F.bool_or(in_year).alias("in_year"), F.bool_or(in_next).alias("in_next"))
    )


def churned_users(orders: DataFrame, year: int, next_year: int | None = None) -> DataFrame:
    """Users who bought in ``year`` and not in ``next_year`` (default year+1).

    The anti join "year minus next year" is evaluated as one grouped pass:
    each user's two flags come from a single aggregation, so there is neither
    a second scan nor a join, and a user with many orders is reduced map-side
    before the shuffle.  NULL users are dropped (a NULL would otherwise empty
    a NOT IN).
    """
    nxt = year + 1 if next_year is None else next_year
    return _year_flags(orders, year, nxt).where(F.col("in_year") & ~F.col("in_next")).select("user_id")


def churned_user_count(orders: DataFrame, year: int, next_year: int | None = None) -> DataFrame:
    """Number of churned users (one row, ``churned_users``)."""
    return churned_users(orders, year, next_year).agg(F.count(F.lit(1)).alias("churned_users"))


def most_active_users(orders: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` users by distinct orders; ties broken by ``user_id``.
    Planned as a per-partition top-k (``TakeOrderedAndProject``)."""
    return (
        orders.where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.count_distinct("id_o").alias("orders_amount"))
        .orderBy(F.col("orders_amount").desc(), F.col("user_id").asc())
        .limit(k)
    )


def seasonality(orders: DataFrame) -> DataFrame:
    """Month's share of its year's distinct orders, rounded to 2 places.

    One aggregation per (year, order) keeps the order's set of months (at
    most 12).  Exploding the sets gives the distinct orders per month; the
    number of (year, order) rows is the year's distinct orders, so an order
    spanning months counts once in its year.  Both read the same per-order
    shuffle (reused), so the orders are read and shuffled once.  The
    per-year totals have one row per calendar year.
    """
    per_order = (
        orders.select(F.year("o_date").alias("year"), F.month("o_date").alias("month"), "id_o")
        .where(F.col("year").isNotNull())  # an order without a date has no month either
        .groupBy("year", "id_o")
        .agg(F.collect_set("month").alias("months"))
    )
    months = (
        per_order.select("year", "id_o", F.explode("months").alias("month"))
        .groupBy("year", "month")
        .agg(F.count("id_o").alias("orders"))
    )
    # size(months) > 0 always holds for a dated order; stating it keeps both
    # branches on the same per-order aggregate, so its shuffle is shared
    years = per_order.groupBy("year").agg(
        F.count(F.when(F.size("months") > 0, F.col("id_o"))).alias("total")
    )
    return months.join(bounded_broadcast(years, MAX_CALENDAR_YEARS), "year", "left").select(
        "year", "month", round_money(safe_ratio("orders", "total")).alias("seasonal_factor")
    )
