"""Canonical frames over stored tables.

The analyses work on a few logical tables:

* order log ``O(id_o, user_id, price decimal, o_date date)``, one row per
  order line (an order id may span rows),
* clients ``(id_client, limit_sum)`` and transactions
  ``(id_client, transaction_date, transaction_time, transaction_sum)``,
* daily traffic ``(day, users)``,
* channel visits ``(channel, year, user_id)`` and channel sales
  ``(channel, year, user_id, revenue)``.

The adapters below derive them from the star-schema tables (``orders``,
``customer``, ``events``).  They are projections: Catalyst prunes the Parquet
read to the used columns and pushes date bounds through the
``timestamp -> date`` cast into the scan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"


def _in_years(ts: str, years: Iterable[int] | None) -> Column | None:
    """``ts`` within one of ``years``, as timestamp ranges (pushed to the
    Parquet scan; ``year(ts) in (...)`` would not be)."""
    if years is None:
        return None
    cond = None
    for y in sorted(set(years)):
        # text literals: independent of the Python and the session time zone
        lo = F.lit(f"{y:04d}-01-01 00:00:00").cast("timestamp_ntz")
        hi = F.lit(f"{y + 1:04d}-01-01 00:00:00").cast("timestamp_ntz")
        c = (F.col(ts) >= lo) & (F.col(ts) < hi)
        cond = c if cond is None else cond | c
    return cond


def load_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """``<base_dir>/<name>.parquet`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


def order_log(orders: DataFrame, money: str = MONEY) -> DataFrame:
    """Order log ``O`` from an ``orders`` table.

    Money becomes ``money`` (``decimal(12,2)``; a wider type for larger
    amounts) so sums are exact and independent of summation order; the order
    timestamp becomes a ``date``.
    """
    return orders.select(
        F.col("o_orderkey").alias("id_o"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").cast(money).alias("price"),
        F.col("o_orderdate").cast("date").alias("o_date"),
    )


def clients_frame(customer: DataFrame, money: str = MONEY) -> DataFrame:
    """Clients with a credit limit: ``(id_client, limit_sum)``."""
    return customer.select(
        F.col("c_custkey").alias("id_client"),
        F.col("c_acctbal").cast(money).alias("limit_sum"),
    )


def order_transactions(orders: DataFrame, money: str = MONEY) -> DataFrame:
    """Transactions from orders: one per order, amount = order total."""
    return orders.select(
        F.col("o_custkey").alias("id_client"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.date_format("o_orderdate", "HH:mm:ss").alias("transaction_time"),
        F.col("o_totalprice").cast(money).alias("transaction_sum"),
    )


def event_transactions(events: DataFrame, money: str = MONEY) -> DataFrame:
    """Transactions from an event log: date and ``HH:mm:ss`` time of each event."""
    return events.select(
        F.col("user_id").alias("id_client"),
        F.col("ts").cast("date").alias("transaction_date"),
        F.date_format("ts", "HH:mm:ss").alias("transaction_time"),
        F.col("value").cast(money).alias("transaction_sum"),
    )


def daily_traffic(events: DataFrame) -> DataFrame:
    """Daily traffic export ``(day, users)``: distinct users per calendar day.

    One row per day, so the result is bounded by the calendar, not by the
    number of events.
    """
    return (
        events.where(F.col("user_id").isNotNull())
        .select(F.col("ts").cast("date").alias("day"), "user_id")
        .groupBy("day")
        .agg(F.count_distinct("user_id").alias("users"))
    )


def channel_visits(events: DataFrame, years: Iterable[int] | None = None) -> DataFrame:
    """Visits ``(channel, year, user_id)``; the channel is the event type.
    ``years`` restricts the scan to those calendar years."""
    cond = _in_years("ts", years)
    if cond is not None:
        events = events.where(cond)
    return events.select(
        F.col("event_type").alias("channel"),
        F.year("ts").alias("year"),
        F.col("user_id"),
    )


def channel_sales(
    orders: DataFrame, customer: DataFrame, years: Iterable[int] | None = None, money: str = MONEY
) -> DataFrame:
    """Sales per client and year with the client's channel (market segment):
    ``(channel, year, user_id, revenue)``.

    Orders are summed per ``(client, year)`` *before* the join, so the join
    sees one row per client-year whatever the skew of orders per client
    (map-side partial aggregation absorbs a client holding many orders).
    ``years`` restricts the orders scan to those calendar years.
    """
    cond = _in_years("o_orderdate", years)
    if cond is not None:
        orders = orders.where(cond)
    per_client_year = (
        orders.select(
            F.col("o_custkey").alias("user_id"),
            F.year("o_orderdate").alias("year"),
            F.col("o_totalprice").cast(money).alias("price"),
        )
        .groupBy("user_id", "year")
        .agg(F.sum("price").alias("revenue"))
    )
    channels = customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("channel"))
    return per_client_year.join(channels, "user_id", "inner").select("channel", "year", "user_id", "revenue")
