"""Stored tables written the way the exports write them, for round trips through the parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def format_orders_text(orders: DataFrame) -> DataFrame:
    """The order log written the way the export writes it (all strings):
    decimal comma, ``dd.MM.yyyy``.  Used for round trips on stored tables."""
    return orders.select(
        F.col("id_o").cast("string").alias("id_o"),
        F.col("user_id").cast("string").alias("user_id"),
        F.replace(F.col("price").cast("string"), F.lit("."), F.lit(",")).alias("price"),
        F.date_format("o_date", "dd.MM.yyyy").alias("o_date"),
    )


def format_traffic_text(daily: DataFrame) -> DataFrame:
    """Daily traffic as the export writes it: ``dd.MM.yyyy`` and counts with
    a no-break space between thousands."""
    return daily.select(
        F.date_format("day", "dd.MM.yyyy").alias("day"),
        F.replace(F.format_number(F.col("users"), 0), F.lit(","), F.lit("\u00a0")).alias("users"),
    )
