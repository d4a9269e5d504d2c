"""The analyses, each a pure ``DataFrame -> DataFrame`` function."""

from basketlens.operators.kpi import (
    average_check,
    churned_user_count,
    churned_users,
    most_active_users,
    order_period,
    order_period_rows,
    order_volume,
    orders_per_user,
    seasonality,
)
from basketlens.operators.segments import (
    last_order_date,
    paying_users,
    rf_segments,
    rfm_code_counts,
    rfm_group_counts,
    rfm_scores,
    rfm_table,
    segment_revenue_by_month,
    user_rfm,
)
from basketlens.operators.journey import rfm_snapshots, segment_sizes, snapshot_scores, snapshot_users
from basketlens.operators.cohorts import (
    active_users,
    cohort_revenue,
    cohort_revenue_by_cutoff,
    frequent_recent_buyers,
    user_cohorts,
)
from basketlens.operators.clients import first_transaction, limit_utilisation, transaction_totals
from basketlens.operators.sketches import bound as sketch_bound
from basketlens.operators.sketches import daily_sketches, merged_users, read_sketches, write_sketches
from basketlens.operators.web import (
    channel_growth,
    channel_revenue_share,
    peak_traffic_days,
    top_channels,
    traffic_by_weekday,
)

__all__ = [
    "active_users",
    "average_check",
    "channel_growth",
    "channel_revenue_share",
    "churned_user_count",
    "churned_users",
    "cohort_revenue",
    "cohort_revenue_by_cutoff",
    "daily_sketches",
    "first_transaction",
    "frequent_recent_buyers",
    "last_order_date",
    "limit_utilisation",
    "merged_users",
    "most_active_users",
    "order_period",
    "order_period_rows",
    "order_volume",
    "orders_per_user",
    "paying_users",
    "peak_traffic_days",
    "read_sketches",
    "rf_segments",
    "rfm_code_counts",
    "rfm_group_counts",
    "rfm_scores",
    "rfm_snapshots",
    "rfm_table",
    "seasonality",
    "segment_revenue_by_month",
    "segment_sizes",
    "sketch_bound",
    "snapshot_scores",
    "snapshot_users",
    "top_channels",
    "traffic_by_weekday",
    "transaction_totals",
    "user_cohorts",
    "user_rfm",
    "write_sketches",
]
