"""RFM snapshots at several cutoff dates (customer-journey comparison).

For cutoffs c_1 < ... < c_K the last dates L_j = max(o_date < c_j) and, for
each order day, its *entry* (the first snapshot with ``o_date < L_j``) come
from one aggregate over the date column: its distinct days, at most those of
the calendar.  As the L_j grow with j, a row is in every snapshot from its
entry on.  So the orders are summed per (user, order, entry), then per (user,
entry), and a window over the user's entries (at most K rows, whatever the
number of orders) adds them up; each sum holds from its entry up to the
user's next one.

The plan has the same columns and steps for any K.  Orders are read once and
never replicated per cutoff: the K rows of a user are made at the end.  Every
shuffle but the last is preceded by a partial aggregate, so a user or order
with a third of all rows sends one row per task and entry.  Exact for orders
whose rows span days.
"""

from __future__ import annotations

import datetime as dt
from typing import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.bounds import MAX_CALENDAR_DAYS, bounded_broadcast
from basketlens.functions.calendar import as_date, days_between, within
from basketlens.functions.profiles import JOURNEY, RfmProfile
from basketlens.operators.segments import score_rfm, with_group_counts


def _sorted_cutoffs(cutoffs: Iterable[dt.date | str]) -> list[dt.date]:
    out = sorted({c if isinstance(c, dt.date) else dt.date.fromisoformat(str(c)) for c in cutoffs})
    if not out:
        raise ValueError("at least one cutoff is needed")
    return out


def snapshot_users(orders: DataFrame, cutoffs: Sequence[dt.date | str], unknown: bool = False) -> DataFrame:
    """Per snapshot and user: ``snapshot, user_id, days, orders, sum_price``
    (same measures as ``user_rfm`` for each cutoff; ``unknown`` as there)."""
    cuts = _sorted_cutoffs(cutoffs)
    k = len(cuts)
    o_date = F.col("o_date")
    dates = F.array(*[as_date(c) for c in cuts])
    before = orders.where(within(orders, before=cuts[-1]))

    # L_1..L_K (NULL: nothing before that cutoff) and the entry of each day
    days = before.agg(F.collect_set("o_date").alias("days"))
    lasts = days.select(
        "days", F.transform(dates, lambda c: F.array_max(F.filter("days", lambda d: d < c))).alias("last_dates")
    )
    last_dates = lasts.select("last_dates").scalar()
    later = F.filter("last_dates", lambda last: last.isNull() | (last <= o_date))
    entries = lasts.select(F.explode("days").alias("o_date"), "last_dates").select("o_date", F.size(later).alias("entry"))

    wanted = before.where((F.col("price") > 0) & (F.lit(unknown) | F.col("user_id").isNotNull()))
    rows = wanted.join(bounded_broadcast(entries.where(F.col("entry") < k), MAX_CALENDAR_DAYS), "o_date")
    per_order = rows.groupBy("user_id", "id_o", "entry").agg(
        F.sum("price").alias("sum_price"), F.max("o_date").alias("last_order")
    )
    first_entry = F.min("entry").over(Window.partitionBy("user_id", "id_o"))
    per_entry = (
        per_order.withColumn("first_entry", first_entry)
        .groupBy("user_id", "entry")
        .agg(
            F.sum("sum_price").alias("sum_price"),
            F.max("last_order").alias("last_order"),
            F.count(F.when(F.col("entry") == F.col("first_entry"), F.col("id_o"))).alias("orders"),
            F.count("user_id").alias("named"),
        )
    )
    by_entry = Window.partitionBy("user_id").orderBy("entry")
    so_far = by_entry.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.coalesce(F.lead("entry").over(by_entry), F.lit(k)) - 1
    running = per_entry.select(
        "user_id",
        F.sum("sum_price").over(so_far).cast(per_entry.schema["sum_price"].dataType).alias("sum_price"),
        F.max("last_order").over(so_far).alias("last_order"),
        F.sum("orders").over(so_far).alias("orders"),
        F.sum("named").over(so_far).alias("named"),
        F.sequence("entry", until).alias("snapshots"),
    )
    long = running.withColumn("j", F.explode("snapshots"))
    return long.select(
        F.element_at(dates, F.col("j") + 1).alias("snapshot"),
        "user_id",
        days_between(F.element_at(last_dates, F.col("j") + 1), "last_order").alias("days"),
        "orders",
        "sum_price",
        *["named"] * unknown,
    )


def snapshot_scores(
    orders: DataFrame, cutoffs: Sequence[dt.date | str], profile: RfmProfile = JOURNEY
) -> DataFrame:
    """Scored users per snapshot (codes and segments, no group counts)."""
    return score_rfm(snapshot_users(orders, cutoffs), profile)


def rfm_snapshots(
    orders: DataFrame, cutoffs: Sequence[dt.date | str], profile: RfmProfile = JOURNEY
) -> DataFrame:
    """RFM tables for every cutoff, stacked with a ``snapshot`` column:
    ``snapshot, segment, user_id, rfm_code, count_by_rfm, count_by_group,
    days, orders, sum_price, share_of_turnover`` (counts and shares per
    snapshot).  Write it with ``sources.write_snapshots``."""
    n_snapshots = len(_sorted_cutoffs(cutoffs))
    scored = score_rfm(snapshot_users(orders, cutoffs, unknown=True), profile)
    return with_group_counts(scored, keys=("snapshot",), key_values=n_snapshots, profile=profile)


def segment_sizes(snapshots: DataFrame, groups: Sequence[str] | None = None) -> DataFrame:
    """Tidy table ``snapshot, segment, count_by_group`` (users per segment per
    snapshot), optionally only for ``groups`` (e.g. VIP and undefined).
    Takes stored snapshots or :func:`snapshot_scores`."""
    src = snapshots if groups is None else snapshots.where(F.col("segment").isin(list(groups)))
    return src.groupBy("snapshot", "segment").agg(F.count(F.lit(1)).alias("count_by_group"))
