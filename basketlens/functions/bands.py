"""Score bands: an ordered list of range rules, first match wins.

A rule is a range with optional bounds, each inclusive or not, so that the
bands can be stated exactly as they are meant, including bands whose bounds
are swapped (an empty range, never matched) and bands that overlap an earlier
one (the earlier rule wins).  The rules become one ``CASE WHEN`` expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``value`` gets ``score`` if ``low (<|<=) value (<|<=) high``.

    ``low``/``high`` of ``None`` leave that side open.  ``between(a, b)`` of
    SQL is ``Rule(s, a, b)``; ``x > a`` is ``Rule(s, low=a, low_inclusive=False)``.
    """

    score: int
    low: float | None = None
    high: float | None = None
    low_inclusive: bool = True
    high_inclusive: bool = True

    def sql(self, value: str) -> str:
        """The rule as SQL text over the expression ``value``."""
        parts = []
        if self.low is not None:
            parts.append(f"{value} {'>=' if self.low_inclusive else '>'} {_num(self.low)}")
        if self.high is not None:
            parts.append(f"{value} {'<=' if self.high_inclusive else '<'} {_num(self.high)}")
        return " AND ".join(parts) if parts else "TRUE"

    def condition(self, value: Column) -> Column:
        cond = F.lit(True)
        if self.low is not None:
            cond = cond & ((value >= self.low) if self.low_inclusive else (value > self.low))
        if self.high is not None:
            cond = cond & ((value <= self.high) if self.high_inclusive else (value < self.high))
        return cond

    def matches(self, value: float) -> bool:
        """Python twin of :meth:`condition`, for tests and fixtures."""
        if self.low is not None and not (value >= self.low if self.low_inclusive else value > self.low):
            return False
        if self.high is not None and not (value <= self.high if self.high_inclusive else value < self.high):
            return False
        return True


def _num(x: float) -> str:
    """Exact SQL literal (``500.1`` is a decimal literal, not a double)."""
    return str(int(x)) if float(x).is_integer() else repr(x)


def between(score: int, low: float, high: float) -> Rule:
    return Rule(score, low, high)


def above(score: int, bound: float) -> Rule:
    return Rule(score, low=bound, low_inclusive=False)


def below(score: int, bound: float) -> Rule:
    return Rule(score, high=bound, high_inclusive=False)


def at_most(score: int, bound: float) -> Rule:
    return Rule(score, high=bound)


def equal(score: int, value: float) -> Rule:
    return Rule(score, value, value)


def score_sql(value: str, rules: Sequence[Rule], default: int = 0) -> str:
    """:func:`score` as SQL text over the column or expression ``value``."""
    if not rules:
        return str(default)
    whens = " ".join(f"WHEN {rule.sql(value)} THEN {rule.score}" for rule in rules)
    return f"CASE {whens} ELSE {default} END"


def score(value: Column | str, rules: Sequence[Rule], default: int = 0) -> Column:
    """First rule whose range holds gets its score; ``default`` otherwise
    (also for NULL values).  For a column name the expression is built from
    SQL text (one call into the JVM instead of one per literal)."""
    if isinstance(value, str):
        return F.expr(score_sql(f"`{value}`", rules, default))
    v = value
    expr = None
    for rule in rules:
        cond = rule.condition(v)
        expr = F.when(cond, F.lit(rule.score)) if expr is None else expr.when(cond, F.lit(rule.score))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def score_value(value: float | None, rules: Sequence[Rule], default: int = 0) -> int:
    """Python twin of :func:`score`."""
    if value is None:
        return default
    for rule in rules:
        if rule.matches(value):
            return rule.score
    return default
