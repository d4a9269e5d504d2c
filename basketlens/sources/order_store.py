"""The order log stored by month.

Each month of orders is one partition ``o_month=<first day>``.  Spark does not
derive a partition filter from a bound on another column, so the operators
state both: ``functions.calendar.within`` adds to every bound on ``o_date``
the bound it implies on ``o_month`` where a frame has that column.  A cutoff
then lists only the months before it, a year only its twelve, also where the
bound is a scalar subquery (the months are pruned when its value is known).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions.calendar import MONTH
from basketlens.sources.sorting import in_order

ORDER_LOG = ("id_o", "user_id", "price", "o_date")


def write_order_log(orders: DataFrame, path: str, sort: tuple[str, ...] = ("o_date", "user_id")) -> None:
    """Write an order log by month; months that ``orders`` has are replaced, others stay.

    Rows are dealt by ranges of (month, ``sort``), so a month is as many files
    as it needs, a large one is not one task's work, and the files of a month
    are in order of ``sort``.  Rows without a date are a partition of their own.
    """
    dated = orders.select(*ORDER_LOG, F.trunc("o_date", "MM").alias(MONTH))
    writer = in_order(dated, MONTH, *sort).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(MONTH).parquet(path)


def read_order_log(spark: SparkSession, path: str) -> DataFrame:
    """The stored order log with its month: ``id_o, user_id, price, o_date, o_month``."""
    stored = spark.read.parquet(path)
    return stored.select(*ORDER_LOG, F.col(MONTH).cast("date").alias(MONTH))
