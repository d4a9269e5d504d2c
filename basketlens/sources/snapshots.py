"""Snapshot sink and reader.

Each RFM snapshot is one partition ``snapshot=<date>`` of a single Parquet
table.  Writing uses dynamic partition overwrite, so rewriting a snapshot
replaces that partition only (the "drop table, create table as select" of a
per-date table) and the job commit makes it atomic per partition.  Reading a
snapshot by date is a partition filter: only that folder is listed and read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.sources.sorting import in_order


def write_snapshots(df: DataFrame, path: str, partition_col: str = "snapshot", sort: Sequence[str] = ()) -> None:
    """Write ``df`` partitioned by ``partition_col``; replace only the
    partitions present in ``df``.  With ``sort`` (``-name``: falling) the
    files of a partition, taken by name, are in that order."""
    ordered = in_order(df, partition_col, *sort) if sort else df
    (
        ordered.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_col)
        .parquet(path)
    )


def read_snapshot(
    spark: SparkSession,
    path: str,
    snapshot: dt.date | str | None = None,
    partition_col: str = "snapshot",
) -> DataFrame:
    """All snapshots, or the one dated ``snapshot`` (partition pruned)."""
    df = spark.read.option("basePath", path).parquet(path)
    if snapshot is None:
        return df
    return df.where(F.col(partition_col) == F.lit(str(snapshot)).cast("date"))
