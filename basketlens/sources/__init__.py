"""Canonical input frames, CSV ingest with quarantine, snapshot sink/reader."""

from basketlens.sources.tables import (
    channel_sales,
    channel_visits,
    clients_frame,
    daily_traffic,
    event_transactions,
    load_table,
    order_log,
    order_transactions,
)
from basketlens.sources.ingest import (
    ParseResult,
    drop_load,
    ingest_daily_traffic_table,
    ingest_orders_table,
    load_daily_traffic,
    load_orders,
    parse_daily_traffic,
    parse_orders,
    store_parsed,
)
from basketlens.sources.order_store import read_order_log, write_order_log
from basketlens.sources.snapshots import read_snapshot, write_snapshots
from basketlens.sources.sorting import in_order

__all__ = [
    "ParseResult",
    "channel_sales",
    "channel_visits",
    "clients_frame",
    "daily_traffic",
    "drop_load",
    "event_transactions",
    "in_order",
    "ingest_daily_traffic_table",
    "ingest_orders_table",
    "load_daily_traffic",
    "load_orders",
    "load_table",
    "order_log",
    "order_transactions",
    "parse_daily_traffic",
    "parse_orders",
    "read_order_log",
    "read_snapshot",
    "store_parsed",
    "write_order_log",
    "write_snapshots",
]
