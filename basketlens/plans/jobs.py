"""Jobs that write their results: lineage cut by a stored table.

After a write, later steps read the files back, so a lost executor costs only
the current stage, not a recomputation from the raw orders.
"""

from __future__ import annotations

import datetime as dt
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions.profiles import JOURNEY, RfmProfile
from basketlens.operators.journey import rfm_snapshots, segment_sizes
from basketlens.sources.snapshots import read_snapshot, write_snapshots


def snapshot_report(
    spark: SparkSession,
    orders: DataFrame,
    cutoffs: Sequence[dt.date | str],
    path: str,
    profile: RfmProfile = JOURNEY,
    groups: Sequence[str] | None = None,
    sort: Sequence[str] = (),
) -> DataFrame:
    """Compute the RFM snapshots, store them partitioned by ``snapshot`` at
    ``path`` (only these snapshots are replaced; in order of ``sort``), and
    return the segment sizes computed from the stored table."""
    write_snapshots(rfm_snapshots(orders, cutoffs, profile), path, sort=sort)
    wanted = [F.lit(str(c)).cast("date") for c in cutoffs]
    stored_snaps = read_snapshot(spark, path).where(F.col("snapshot").isin(wanted))
    return segment_sizes(stored_snaps, groups)
