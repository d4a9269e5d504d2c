"""Column-expression helpers (all JVM-side built-ins, no UDFs)."""

from basketlens.functions.calendar import (
    days_between,
    period_label,
    weekday_name,
    year_range,
)
from basketlens.functions.numeric import round_money, safe_ratio
from basketlens.functions.bands import Rule, score

__all__ = [
    "Rule",
    "days_between",
    "period_label",
    "round_money",
    "safe_ratio",
    "score",
    "weekday_name",
    "year_range",
]
