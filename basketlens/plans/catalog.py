"""Registered queries: name -> ``(spark, base_dir) -> DataFrame``.

Each query reads the stored tables of ``base_dir`` in full and runs one
operator of the library with the parameters of ``plans.params``.  Money
columns (exact decimals inside the operators) are returned as doubles so
results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from basketlens import operators as ops
from basketlens.functions.profiles import RF_BASIC
from basketlens.plans import params as P
from basketlens.sources import tables as T
from basketlens.functions.numeric import round_money
from basketlens.plans.round_trip import format_orders_text, format_traffic_text
from basketlens.sources.ingest import parse_daily_traffic, parse_orders

Query = Callable[[SparkSession, str], DataFrame]


def as_doubles(df: DataFrame) -> DataFrame:
    """Decimal columns as doubles (after all exact arithmetic is done)."""
    cols = [
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def _orders(spark: SparkSession, base: str) -> DataFrame:
    return T.order_log(T.load_table(spark, base, "orders"))


def _daily(spark: SparkSession, base: str) -> DataFrame:
    return T.daily_traffic(T.load_table(spark, base, "events"))


def _sales(spark: SparkSession, base: str, years: tuple[int, ...]) -> DataFrame:
    return T.channel_sales(T.load_table(spark, base, "orders"), T.load_table(spark, base, "customer"), years)


def _rfm_scaled_scores(spark: SparkSession, base: str) -> DataFrame:
    return ops.rfm_scores(_orders(spark, base), P.RFM_CUTOFF, P.JOURNEY_SCALED)


def _snapshots(spark: SparkSession, base: str) -> DataFrame:
    return ops.rfm_snapshots(_orders(spark, base), P.SNAPSHOT_CUTOFFS, P.JOURNEY_SCALED)


def _snapshot_scores(spark: SparkSession, base: str) -> DataFrame:
    return ops.snapshot_scores(_orders(spark, base), P.SNAPSHOT_CUTOFFS, P.JOURNEY_SCALED)


def _ingest_orders(spark: SparkSession, base: str) -> DataFrame:
    return parse_orders(format_orders_text(_orders(spark, base))).good


def _ingest_daily(spark: SparkSession, base: str) -> DataFrame:
    return parse_daily_traffic(format_traffic_text(_daily(spark, base))).good


def _recent_since(spark: SparkSession, base: str) -> DataFrame:
    o = _orders(spark, base)
    return ops.active_users(o, since=ops.last_order_date(o, P.COHORT_CUTOFF))


def _recent_before(spark: SparkSession, base: str) -> DataFrame:
    o = _orders(spark, base)
    # o_date < last implies o_date < cutoff; the literal bound reaches the scan
    return ops.active_users(o.where(F.col("o_date") < F.lit(P.COHORT_CUTOFF)), before=ops.last_order_date(o, P.COHORT_CUTOFF))


def _frequent_buyers(spark: SparkSession, base: str) -> DataFrame:
    o = _orders(spark, base)
    return ops.frequent_recent_buyers(
        o, ops.last_order_date(o, P.COHORT_CUTOFF), P.RECENT_WINDOW_DAYS, P.RECENT_MIN_ROWS, cutoff=P.COHORT_CUTOFF
    )


def _channel_users_sketched(spark: SparkSession, base: str) -> DataFrame:
    """Users per channel and year, exact, and whether the estimate merged from daily sketches keeps its bound."""
    events = T.load_table(spark, base, "events")
    keys = [F.col("event_type").alias("channel"), F.year("day").alias("year")]
    daily = events.select("event_type", "user_id", F.col("ts").cast("date").alias("day")).where(F.col("day").isNotNull())
    exact = daily.groupBy(*keys).agg(F.count_distinct("user_id").alias("users"))
    merged = ops.merged_users(ops.daily_sketches(daily, ["event_type"]), keys).withColumnRenamed("users", "estimate")
    joined = exact.join(merged, ["channel", "year"], "left")
    near = F.abs(F.coalesce("estimate", F.lit(0)) - F.col("users")) <= F.lit(ops.sketch_bound()) * F.col("users")
    return joined.select("channel", "year", "users", near.alias("within_bound"))


def _rounded(df: DataFrame, column: str) -> DataFrame:
    """Averages to 2 places, to compare across engines (the operators keep them full)."""
    return df.withColumn(column, round_money(column))


def _cohort_revenue(spark: SparkSession, base: str) -> DataFrame:
    return ops.cohort_revenue_by_cutoff(_orders(spark, base), P.COHORT_CUTOFF)


_RAW: dict[str, Query] = {
    # order KPIs
    "order_period": lambda s, b: ops.order_period(_orders(s, b)),
    "order_period_rows": lambda s, b: ops.order_period_rows(_orders(s, b)),
    "order_volume": lambda s, b: ops.order_volume(_orders(s, b)),
    "avg_check_rows": lambda s, b: _rounded(ops.average_check(_orders(s, b), level="row"), "average"),
    "avg_check_orders": lambda s, b: ops.average_check(_orders(s, b), level="order"),
    "orders_per_user_year": lambda s, b: _rounded(ops.orders_per_user(_orders(s, b), by="year"), "average_orders"),
    "orders_per_user_month": lambda s, b: _rounded(ops.orders_per_user(_orders(s, b), by="month"), "average_orders"),
    "churned_users": lambda s, b: ops.churned_users(_orders(s, b), P.CHURN_YEAR),
    "churned_user_count": lambda s, b: ops.churned_user_count(_orders(s, b), P.CHURN_YEAR),
    "most_active_users": lambda s, b: ops.most_active_users(_orders(s, b), k=P.TOP_USERS),
    "seasonality": lambda s, b: ops.seasonality(_orders(s, b)),
    # RF behaviour groups
    "rf_segments": lambda s, b: ops.rf_segments(_orders(s, b), P.RF_CUTOFF, RF_BASIC),
    "rf_segments_scaled": lambda s, b: ops.rf_segments(_orders(s, b), P.RF_CUTOFF, P.RF_SCALED),
    "rf_segment_month": lambda s, b: ops.segment_revenue_by_month(_orders(s, b), P.RF_CUTOFF, P.RF_SCALED),
    # cohorts, activity
    "user_cohorts": lambda s, b: ops.user_cohorts(_orders(s, b), P.COHORT_CUTOFF),
    "cohort_revenue": _cohort_revenue,
    "active_users": _recent_since,
    "active_users_before": _recent_before,
    "frequent_recent_buyers": _frequent_buyers,
    # RFM
    "rfm_market": lambda s, b: ops.rfm_table(_orders(s, b), None, P.MARKET),
    "rfm_journey": lambda s, b: ops.rfm_table(_orders(s, b), P.RFM_CUTOFF, P.JOURNEY),
    "rfm_journey_scaled": lambda s, b: ops.rfm_table(_orders(s, b), P.RFM_CUTOFF, P.JOURNEY_SCALED),
    "rfm_code_counts": lambda s, b: ops.rfm_code_counts(_rfm_scaled_scores(s, b)),
    "rfm_group_rollup": lambda s, b: ops.rfm_group_counts(_rfm_scaled_scores(s, b), rollup=True),
    "paying_users": lambda s, b: ops.paying_users(_orders(s, b)),
    "rfm_snapshots": _snapshots,
    "segment_sizes": lambda s, b: ops.segment_sizes(_snapshot_scores(s, b)),
    "segment_sizes_monthly": lambda s, b: ops.segment_sizes(
        ops.snapshot_scores(_orders(s, b), P.MONTHLY_CUTOFFS, P.JOURNEY_SCALED)
    ),
    "segment_sizes_subset": lambda s, b: ops.segment_sizes(_snapshot_scores(s, b), P.SNAPSHOT_GROUPS),
    # clients and transactions
    "transaction_totals": lambda s, b: _rounded(
        ops.transaction_totals(T.order_transactions(T.load_table(s, b, "orders"))), "transactions_average"
    ),
    "first_transaction": lambda s, b: ops.first_transaction(
        T.clients_frame(T.load_table(s, b, "customer")), T.event_transactions(T.load_table(s, b, "events"))
    ),
    "limit_utilisation": lambda s, b: ops.limit_utilisation(
        T.clients_frame(T.load_table(s, b, "customer")),
        T.order_transactions(T.load_table(s, b, "orders")),
        P.LIMIT_THRESHOLD,
    ),
    "limit_utilisation_high": lambda s, b: ops.limit_utilisation(
        T.clients_frame(T.load_table(s, b, "customer")),
        T.order_transactions(T.load_table(s, b, "orders")),
        P.LIMIT_THRESHOLD_HIGH,
    ),
    "limit_utilisation_client": lambda s, b: ops.limit_utilisation(
        T.clients_frame(T.load_table(s, b, "customer")),
        T.order_transactions(T.load_table(s, b, "orders")),
        P.LIMIT_THRESHOLD,
        per="client",
    ),
    # traffic and channels
    "peak_traffic_day": lambda s, b: ops.peak_traffic_days(_daily(s, b)),
    "traffic_by_weekday": lambda s, b: ops.traffic_by_weekday(_daily(s, b)),
    "top_channels_traffic": lambda s, b: ops.top_channels(
        T.channel_visits(T.load_table(s, b, "events"), [P.TRAFFIC_YEAR]), k=P.TOP_CHANNELS, year=P.TRAFFIC_YEAR
    ),
    "channel_users_sketched": _channel_users_sketched,
    "top_channels_revenue": lambda s, b: ops.channel_revenue_share(
        _sales(s, b, (P.CHANNEL_YEAR,)), P.CHANNEL_YEAR, k=P.TOP_CHANNELS
    ),
    "channel_growth": lambda s, b: ops.channel_growth(
        _sales(s, b, (P.CHANNEL_YEAR, P.CHANNEL_PREV_YEAR)), P.CHANNEL_YEAR, P.CHANNEL_PREV_YEAR, k=1
    ),
    # ingest round trips
    "ingest_orders": _ingest_orders,
    "ingest_daily_traffic": _ingest_daily,
}


def _finish(fn: Query) -> Query:
    def run(spark: SparkSession, base_dir: str) -> DataFrame:
        return as_doubles(fn(spark, base_dir))

    run.__name__ = getattr(fn, "__name__", "query")
    return run


QUERIES: dict[str, Query] = {name: _finish(fn) for name, fn in _RAW.items()}


def queries() -> dict[str, Query]:
    return dict(QUERIES)
