"""Calendar expressions: period labels, weekday names, day differences."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTH = "o_month"  # partition column of the order log stored by month


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_date(value: dt.date | str | Column) -> Column:
    """A date literal (or pass a Column through)."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("date")


def period_label(col: Column | str) -> Column:
    """Two-digit year and month, e.g. 2017-01-15 -> ``1701``."""
    return F.date_format(_c(col), "yyMM")


def weekday_name(col: Column | str) -> Column:
    """Full English weekday name, e.g. ``Tuesday``."""
    return F.date_format(_c(col), "EEEE")


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole days from ``earlier`` to ``later`` (both dates)."""
    return F.datediff(_c(later), _c(earlier))


def year_range(col: Column | str, year: int) -> Column:
    """``col`` falls in calendar ``year``, written as a range so the bound
    reaches the Parquet scan (``year(col) = y`` would not be pushed)."""
    c = _c(col)
    return (c >= as_date(dt.date(year, 1, 1))) & (c < as_date(dt.date(year + 1, 1, 1)))


def within(
    orders: DataFrame,
    since: dt.date | str | Column | None = None,
    before: dt.date | str | Column | None = None,
) -> Column:
    """``since <= o_date < before`` (either bound may be left out).

    On an order log stored by month, the bounds that this implies on the
    month are stated as well, so that other months are not listed.
    """
    cond = F.lit(True)
    if since is not None:
        cond = cond & (F.col("o_date") >= as_date(since))
        if MONTH in orders.columns:
            cond = cond & (F.col(MONTH) >= F.trunc(as_date(since), "MM"))
    if before is not None:
        cond = cond & (F.col("o_date") < as_date(before))
        if MONTH in orders.columns:
            cond = cond & (F.col(MONTH) < as_date(before))
    return cond


def within_years(orders: DataFrame, *years: int) -> Column:
    """``o_date`` falls in one of the calendar years (months as in :func:`within`)."""
    cond = F.lit(False)
    for y in years:
        cond = cond | within(orders, dt.date(y, 1, 1), dt.date(y + 1, 1, 1))
    return cond
