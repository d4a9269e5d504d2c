"""Recency / frequency / monetary scoring and segmentation.

Scalars of the analysis ("last date before the cutoff") are scalar
subqueries: planned once, run as a one-row job, used as a literal.  The
three per-user measures come from *one* aggregation over one scan (no
R / F / M frames joined back together), and every count per code or segment
is a tiny grouped frame joined back by broadcast; its size is bounded by the
profile (at most 6^3 codes, a handful of segments), not by the data.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.bands import score
from basketlens.functions.calendar import days_between, period_label, within
from basketlens.functions.numeric import round_money, safe_ratio
from basketlens.functions.profiles import JOURNEY, RF_BASIC, RfmProfile, RfProfile
from basketlens.functions.bounds import bounded_broadcast

DateLike = dt.date | str


def last_order_date(orders: DataFrame, cutoff: DateLike | None = None) -> Column:
    """Latest order date strictly before ``cutoff`` (all orders if None), as
    a scalar-subquery column.  The cutoff bound is pushed into the scan."""
    src = orders if cutoff is None else orders.where(within(orders, before=cutoff))
    return src.agg(F.max("o_date")).scalar()


def analysed_rows(orders: DataFrame, cutoff: DateLike | None, last: Column) -> DataFrame:
    """Rows before the last date, strictly (the last day itself is left out).

    The literal ``o_date < cutoff`` is implied by ``o_date < last`` but is
    stated as well: unlike the subquery bound it reaches the Parquet scan
    and skips row groups.  ``cutoff=None`` keeps every row.
    """
    if cutoff is None:
        return orders
    return orders.where(within(orders, before=cutoff) & (F.col("o_date") < last))


# ---------------------------------------------------------------------------
# RFM (three scores)
# ---------------------------------------------------------------------------


def user_rfm(orders: DataFrame, cutoff: DateLike | None = None, unknown: bool = False) -> DataFrame:
    """Per user with a positive-price order in the window:
    ``user_id, days`` (since last order), ``orders`` (distinct ids),
    ``sum_price``.  One scan, one aggregation.  ``unknown`` adds a row with a
    NULL user for the orders without one (their revenue counts in totals) and
    ``named``, 0 in that row: a test of it stays above the aggregate, so that
    all branches share one read."""
    last = last_order_date(orders, cutoff)
    wanted = F.col("price") > 0
    if not unknown:
        wanted = wanted & F.col("user_id").isNotNull()
    rows = analysed_rows(orders.where(wanted), cutoff, last)
    per_user = rows.groupBy("user_id").agg(
        F.max("o_date").alias("last_order"),
        F.count_distinct("id_o").alias("orders"),
        F.sum("price").alias("sum_price"),
        F.count("user_id").alias("named"),
    )
    return per_user.select(
        "user_id", days_between(last, "last_order").alias("days"), "orders", "sum_price", *["named"] * unknown
    )


def score_rfm(per_user: DataFrame, profile: RfmProfile = JOURNEY) -> DataFrame:
    """Add ``r_score, f_score, m_score``, ``rfm_code`` (``R5-F4-M3``) and
    ``segment`` to a frame with ``days, orders, sum_price``."""
    scored = per_user.select(
        "*",
        score("days", profile.r_rules).alias("r_score"),
        score("orders", profile.f_rules).alias("f_score"),
        score("sum_price", profile.m_rules).alias("m_score"),
    )
    digits = "concat(cast(r_score AS STRING), cast(f_score AS STRING), cast(m_score AS STRING))"
    return scored.select(
        "*",
        F.expr("concat('R', cast(r_score AS STRING), '-F', cast(f_score AS STRING), '-M', cast(m_score AS STRING))")
        .alias("rfm_code"),
        profile.segment_expr(digits).alias("segment"),
    )


def rfm_scores(orders: DataFrame, cutoff: DateLike | None = None, profile: RfmProfile = JOURNEY) -> DataFrame:
    """Scored users (see :func:`user_rfm`, :func:`score_rfm`)."""
    return score_rfm(user_rfm(orders, cutoff), profile)


def with_group_counts(
    scored: DataFrame, keys: tuple[str, ...] = (), key_values: int = 1, profile: RfmProfile = JOURNEY
) -> DataFrame:
    """Attach ``count_by_rfm``, ``count_by_group`` and ``share_of_turnover``.

    Each row gets its code's and its segment's user count (every row, not
    one arbitrary row per group).  The share is the user's sum over the sum
    of all rows (per ``keys``, e.g. per snapshot), rounded to 2 places; a row
    without a user counts in that total only and is not returned.

    All three come from one small lookup grouped by (keys, segment, code):
    at most the codes of ``profile`` (the one of ``scored``) per key value
    (``key_values`` of them, e.g. the number of snapshots) whatever the
    number of users, joined back to the users with a single broadcast join.
    """
    k = list(keys)
    counted = F.count_if(F.col("named") > 0) if "named" in scored.columns else F.count(F.lit(1))
    per_code = scored.groupBy(*k, "segment", "rfm_code").agg(
        counted.alias("count_by_rfm"), F.sum("sum_price").alias("code_sum")
    )
    per_group = per_code.groupBy(*k, "segment").agg(F.sum("count_by_rfm").alias("count_by_group"))
    lookup = per_code.join(per_group, [*k, "segment"])
    # every branch uses the counts, so that all share one per-user aggregate
    code_sum = F.sum(F.when(F.col("count_by_rfm") >= 0, F.col("code_sum")))
    extra: list[str] = []
    if k:
        totals = per_code.groupBy(*k).agg(code_sum.alias("overall_sum"))
        lookup = lookup.join(totals, k)
        overall = F.col("overall_sum")
        extra = ["overall_sum"]
    else:
        overall = per_code.agg(code_sum).scalar()
    lookup = lookup.select(*k, "segment", "rfm_code", "count_by_rfm", "count_by_group", *extra)
    users = scored.where(F.col("named") > 0) if "named" in scored.columns else scored
    joined = users.join(bounded_broadcast(lookup, profile.max_codes() * key_values), [*k, "segment", "rfm_code"])
    return joined.select(
        *k,
        "segment",
        "user_id",
        "rfm_code",
        "count_by_rfm",
        "count_by_group",
        "days",
        "orders",
        "sum_price",
        round_money(safe_ratio(F.col("sum_price"), overall)).alias("share_of_turnover"),
    )


def rfm_table(orders: DataFrame, cutoff: DateLike | None = None, profile: RfmProfile = JOURNEY) -> DataFrame:
    """The consolidated RFM table: ``segment, user_id, rfm_code,
    count_by_rfm, count_by_group, days, orders, sum_price, share_of_turnover``.

    ``cutoff=None``: last date = latest order, every positive-price row is
    used (the market-activity variant).  With a cutoff: last date = latest
    order before it, rows strictly before the last date (so ``days >= 1``);
    the turnover total uses the same rows, those without a user included.
    """
    return with_group_counts(score_rfm(user_rfm(orders, cutoff, unknown=True), profile), profile=profile)


def rfm_code_counts(scored: DataFrame) -> DataFrame:
    """Users per RFM code: ``rfm_code, users``."""
    return scored.groupBy("rfm_code").agg(F.count(F.lit(1)).alias("users"))


def rfm_group_counts(scored: DataFrame, rollup: bool = True, total_label: str = "TOTAL") -> DataFrame:
    """Users per segment: ``segment, users``; with ``rollup`` one more row
    (``segment = total_label``) holds all users."""
    if not rollup:
        return scored.groupBy("segment").agg(F.count(F.lit(1)).alias("users"))
    return scored.rollup("segment").agg(
        F.count(F.lit(1)).alias("users"), F.grouping("segment").alias("_total")
    ).select(
        F.when(F.col("_total") == 1, F.lit(total_label)).otherwise(F.col("segment")).alias("segment"),
        "users",
    )


def paying_users(orders: DataFrame) -> DataFrame:
    """Distinct users with a positive-price order (one row, ``paying_users``)."""
    return orders.where(F.col("price") > 0).agg(F.count_distinct("user_id").alias("paying_users"))


# ---------------------------------------------------------------------------
# RF (two scores) behaviour groups
# ---------------------------------------------------------------------------


def rf_segments(orders: DataFrame, cutoff: DateLike | None, profile: RfProfile = RF_BASIC) -> DataFrame:
    """Per user: ``user_id, days, orders, rf_code, segment``.

    Recency and frequency over rows strictly before the last date before
    ``cutoff``; no price filter.  The cutoff is a real date (a text compare
    of ``YYYY-MM-DD`` with ``YYYY/MM/DD`` would let a whole year through).
    """
    last = last_order_date(orders, cutoff)
    rows = analysed_rows(orders.where(F.col("user_id").isNotNull()), cutoff, last)
    per_user = rows.groupBy("user_id").agg(
        F.max("o_date").alias("last_order"), F.count_distinct("id_o").alias("orders")
    )
    return _score_rf(per_user, last, profile)


def _score_rf(per_user: DataFrame, last: Column, profile: RfProfile, keep: tuple[str, ...] = ()) -> DataFrame:
    """RF scores and groups of ``user_id, last_order, orders``, with the columns ``keep``."""
    with_days = per_user.select("user_id", *keep, days_between(last, "last_order").alias("days"), "orders")
    scored = with_days.select(
        "*",
        score("days", profile.r_rules, default=profile.r_default).alias("r_score"),
        score("orders", profile.f_rules, default=profile.f_default).alias("f_score"),
    )
    code = "concat(cast(r_score AS STRING), cast(f_score AS STRING))"
    return scored.select(
        "user_id",
        *keep,
        "days",
        "orders",
        F.expr(code).alias("rf_code"),
        profile.segment_expr(code, "orders").alias("segment"),
    )


def segment_revenue_by_month(
    orders: DataFrame, cutoff: DateLike | None, profile: RfProfile = RF_BASIC
) -> DataFrame:
    """Revenue and active users per behaviour group and month:
    ``segment, period (yyMM), sum_price, users``.

    The orders are read once and nothing is joined: an order counts in one
    of its months, so per (user, month) there are the revenue, the last
    day and the orders that begin there, and a window over the user's months
    (at most one row per month) gives each of them the user's scores.
    Revenue of orders without a user is in the NULL segment.
    """
    last = last_order_date(orders, cutoff)
    rows = analysed_rows(orders, cutoff, last)
    per_order = rows.groupBy("user_id", "id_o", period_label("o_date").alias("period")).agg(
        F.sum("price").alias("sum_price"), F.max("o_date").alias("last_order")
    )
    first_period = F.min("period").over(Window.partitionBy("user_id", "id_o"))
    monthly = (
        per_order.withColumn("first_period", first_period)
        .groupBy("user_id", "period")
        .agg(
            F.sum("sum_price").alias("sum_price"),
            F.max("last_order").alias("last_order"),
            F.count(F.when(F.col("period") == F.col("first_period"), F.col("id_o"))).alias("orders"),
        )
    )
    months = Window.partitionBy("user_id")
    scored = _score_rf(
        monthly.select(
            "user_id", "period", "sum_price", F.max("last_order").over(months).alias("last_order"), F.sum("orders").over(months).alias("orders")
        ),
        last,
        profile,
        ("period", "sum_price"),
    )
    segment = F.when(F.col("user_id").isNotNull(), F.col("segment")).alias("segment").alias("segment")
    return scored.groupBy(segment, "period").agg(
        F.sum("sum_price").alias("sum_price"), F.count("user_id").alias("users")
    )
