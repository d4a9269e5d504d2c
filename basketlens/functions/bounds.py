"""Broadcasts only for frames whose size is bounded by construction.

An explicit broadcast hint is given only with a stated upper bound on the
frame's rows that does not depend on the data volume (number of score
codes, segments, cutoffs, calendar days or years; rows of a few fixed-width
columns, so 4 million of them are some 100 MB).  If that bound is above
``MAX_BROADCAST_ROWS`` no hint is given and adaptive execution chooses the
join from the sizes it measures at run time (sort-merge when large).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 4_000_000

# Bound used by the operators; that of score codes is RfmProfile.max_codes.
MAX_CALENDAR_YEARS = 10_000  # four-digit years
MAX_CALENDAR_DAYS = 366 * MAX_CALENDAR_YEARS


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` if ``df`` can hold at most ``max_rows`` rows and that
    is small enough; else ``df`` unchanged (AQE decides at run time)."""
    return F.broadcast(df) if max_rows <= MAX_BROADCAST_ROWS else df
