"""Clients and transactions: totals, first transaction, credit-limit use."""

from __future__ import annotations

from decimal import Decimal
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.hot_keys import spread_join
from basketlens.functions.numeric import round_money, safe_ratio


def transaction_totals(transactions: DataFrame) -> DataFrame:
    """``transactions_count, transactions_sum, transactions_average``
    (average of non-NULL amounts) in one pass."""
    return transactions.agg(
        F.count(F.lit(1)).alias("transactions_count"),
        F.sum("transaction_sum").alias("transactions_sum"),
        safe_ratio(F.sum("transaction_sum"), F.count("transaction_sum")).alias("transactions_average"),
    )


def _stamp() -> Column:
    return F.concat(F.col("transaction_date").cast("string"), F.lit(" "), F.trim("transaction_time")).try_cast("timestamp_ntz")


def unreadable_times(transactions: DataFrame) -> DataFrame:
    """Transactions whose date and time are not a point in time."""
    return transactions.where(_stamp().isNull())


def first_transaction(clients: DataFrame, transactions: DataFrame) -> DataFrame:
    """Every client with the date and time of its first transaction,
    ``id_client, datetime`` (NULL for clients without one).

    Transactions are reduced to one row per client *before* the left join,
    so a client with a huge number of transactions is reduced map-side and
    the join is one-to-one.  Date and time are read as a timestamp without a
    time zone (one-digit hours and fractions too), so no session zone moves
    them; :func:`unreadable_times` gives the transactions left out.
    """
    first = transactions.groupBy("id_client").agg(F.min(_stamp()).alias("datetime"))
    return clients.select("id_client").join(first, "id_client", "left")


def limit_utilisation(
    clients: DataFrame,
    transactions: DataFrame,
    threshold: float = 70,
    per: Literal["transaction", "client"] = "transaction",
    salts: int = 32,
) -> DataFrame:
    """Spending as a percentage of the client's limit, where above
    ``threshold``: ``id_client, limit_sum, spent, used_pct`` (2 places).

    ``per='transaction'`` compares each transaction with the limit;
    ``per='client'`` compares the client's total.  The comparison is made on
    exact decimals (``spent * 100`` against ``threshold * limit``), so a use
    of exactly the threshold is not above it; only the shown percentage is
    rounded.  A zero limit drops the row; negative limits give negative use.

    Only clients with transactions can pass the filter, so the join is an
    inner join.  It is the one join on raw rows: clients that own more than a
    hundredth of the transactions are found first and theirs are dealt over
    ``salts`` parts (:func:`functions.hot_keys.spread_join`; 1: a plain join).
    In ``per='client'`` mode transactions are summed per client first.
    """
    tx = transactions.select("id_client", F.col("transaction_sum").alias("spent"))
    if per == "client":
        tx = tx.groupBy("id_client").agg(F.sum("spent").alias("spent"))
    limit, bar = F.col("limit_sum"), F.lit(Decimal(str(threshold))) * F.col("limit_sum")
    above = F.when(limit > 0, F.col("spent") * 100 > bar).when(limit < 0, F.col("spent") * 100 < bar)
    limits = clients.select("id_client", "limit_sum")
    joined = tx.join(limits, "id_client") if per == "client" else spread_join(tx, limits, "id_client", salts=salts)
    used = round_money(safe_ratio(F.col("spent"), limit) * 100)
    return joined.where(above).select("id_client", "limit_sum", "spent", used.alias("used_pct"))
