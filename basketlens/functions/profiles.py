"""Scoring profiles: R/F/M bands and the code -> segment maps.

A profile is plain data (frozen dataclasses); the operators turn it into
``CASE WHEN`` expressions, so the thresholds and maps are parameters, not code.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketlens.functions.bands import Rule, above, at_most, below, between, equal, score_value

UNDEFINED = "undefined_group"


@dataclass(frozen=True)
class SegmentList:
    """Codes (``"R1F1M1"`` digits) that belong to ``name``."""

    name: str
    codes: tuple[str, ...]


@dataclass(frozen=True)
class RfmProfile:
    """Recency (days), frequency (distinct orders) and monetary (sum) bands,
    and an ordered segment map: the first list holding a code wins."""

    name: str
    r_rules: tuple[Rule, ...]
    f_rules: tuple[Rule, ...]
    m_rules: tuple[Rule, ...]
    segments: tuple[SegmentList, ...]
    default_segment: str = UNDEFINED

    def max_codes(self) -> int:
        """Most codes the bands can give: distinct scores of each, the default 0 included."""
        n = 1
        for rules in (self.r_rules, self.f_rules, self.m_rules):
            n *= len({0, *(rule.score for rule in rules)})
        return n

    def segment_of(self, code: str) -> str:
        for seg in self.segments:
            if code in seg.codes:
                return seg.name
        return self.default_segment

    def segment_sql(self, code: str) -> str:
        """SQL text of the code -> segment CASE over the expression ``code``."""
        whens = " ".join(
            f"WHEN {code} IN ({', '.join(repr(c) for c in dict.fromkeys(seg.codes))}) THEN {seg.name!r}"
            for seg in self.segments
        )
        return f"CASE {whens} ELSE {self.default_segment!r} END" if whens else repr(self.default_segment)

    def segment_expr(self, code: Column | str) -> Column:
        """``code`` -> segment as one CASE over IN lists (Catalyst makes InSet).
        A string is taken as a SQL expression."""
        if isinstance(code, str):
            return F.expr(self.segment_sql(code))
        expr = None
        for seg in self.segments:
            cond = code.isin(list(dict.fromkeys(seg.codes)))
            expr = F.when(cond, F.lit(seg.name)) if expr is None else expr.when(cond, F.lit(seg.name))
        if expr is None:
            return F.lit(self.default_segment)
        return expr.otherwise(F.lit(self.default_segment))

    def scores(self, days: float | None, orders: float | None, money: float | None) -> tuple[int, int, int]:
        """Python twin of the band expressions (tests, fixtures)."""
        return (
            score_value(days, self.r_rules),
            score_value(orders, self.f_rules),
            score_value(money, self.m_rules),
        )

    def segment_names(self) -> list[str]:
        return [s.name for s in self.segments] + [self.default_segment]


@dataclass(frozen=True)
class RfProfile:
    """Two-score (recency, frequency) profile with behaviour groups.

    Groups, first match wins: code in ``good_codes``; code in ``bad_codes``;
    raw order count below ``lost_max_orders`` and code not in
    ``lost_excluded_codes``; else ``default_segment``.
    """

    name: str
    r_rules: tuple[Rule, ...]
    f_rules: tuple[Rule, ...]
    good_name: str
    good_codes: tuple[str, ...]
    bad_name: str
    bad_codes: tuple[str, ...]
    lost_name: str
    lost_max_orders: int
    lost_excluded_codes: tuple[str, ...]
    default_segment: str = UNDEFINED
    r_default: int = 1
    f_default: int = 3

    def segment_sql(self, code: str, orders: str) -> str:
        def lst(codes: tuple[str, ...]) -> str:
            return ", ".join(repr(c) for c in codes)

        return (
            f"CASE WHEN {code} IN ({lst(self.good_codes)}) THEN {self.good_name!r} "
            f"WHEN {code} IN ({lst(self.bad_codes)}) THEN {self.bad_name!r} "
            f"WHEN {orders} < {self.lost_max_orders} AND {code} NOT IN ({lst(self.lost_excluded_codes)}) "
            f"THEN {self.lost_name!r} ELSE {self.default_segment!r} END"
        )

    def segment_expr(self, code: Column | str, orders: Column | str) -> Column:
        if isinstance(code, str) and isinstance(orders, str):
            return F.expr(self.segment_sql(code, orders))
        code = F.expr(code) if isinstance(code, str) else code
        orders = F.col(orders) if isinstance(orders, str) else orders
        return (
            F.when(code.isin(list(self.good_codes)), F.lit(self.good_name))
            .when(code.isin(list(self.bad_codes)), F.lit(self.bad_name))
            .when(
                (orders < self.lost_max_orders) & ~code.isin(list(self.lost_excluded_codes)),
                F.lit(self.lost_name),
            )
            .otherwise(F.lit(self.default_segment))
        )


def all_codes(max_score: int = 5) -> list[str]:
    """Every three-digit code with scores 1..max_score (125 for 5)."""
    digits = [str(i) for i in range(1, max_score + 1)]
    return ["".join(p) for p in product(digits, repeat=3)]


# ---------------------------------------------------------------------------
# Thresholds and segment lists that must equal the analysed
# scripts for results to agree.  Stated in their original order; NEW lists
# 524 twice and HOPEFOOL keeps its original spelling.
# ---------------------------------------------------------------------------

# Customer-journey profile (bands as meant: R 1 = over a year ago ... 5 = under 30 days).
JOURNEY = RfmProfile(
    name="journey",
    r_rules=(above(1, 365), between(2, 100, 365), between(3, 60, 100), between(4, 30, 60), below(5, 30)),
    f_rules=(equal(1, 1), between(2, 2, 10), between(3, 10, 20), between(4, 20, 50), above(5, 50)),
    m_rules=(between(1, 0, 500), between(2, 500, 1000), between(3, 1000, 10000), between(4, 10000, 50000), above(5, 50000)),
    segments=(
        SegmentList("VIP", ("555", "455", "355", "345", "354", "445", "325", "335", "554", "545")),
        SegmentList("NEW", ("411", "412", "413", "414", "415", "421", "422", "423", "424", "425",
                            "511", "512", "514", "515", "521", "524", "524", "525")),
        SegmentList("CHURNED", ("144", "145", "154", "155", "244", "224", "314", "245", "223", "254", "255", "241",
                                "242", "313", "243", "251", "252", "253", "225", "231", "232", "233", "234", "235")),
        SegmentList("REGULAR", ("544", "543", "533", "534", "535", "454", "434", "435", "531", "443", "441", "442",
                                "444", "333", "341", "342", "343", "344", "321", "322", "323", "324", "334")),
        SegmentList("HOPEFOOL", ("221", "222", "115", "433", "311", "312", "315", "124", "125", "523", "513", "522")),
        SegmentList("LOST", ("111", "112", "113", "114", "121", "122", "123", "134", "215", "214", "213", "212", "211")),
    ),
)

# Market-activity profile, bands exactly as written there: the R bands are
# inverted and two of them are empty ranges (100..60, 60..30), so only R
# scores 1, 2 and 5 occur.
MARKET = RfmProfile(
    name="market",
    r_rules=(below(1, 365), between(2, 100, 365), between(3, 100, 60), between(4, 60, 30), above(5, 30)),
    f_rules=(between(1, 1, 2), between(2, 2, 10), between(3, 10, 20), between(4, 20, 50), above(5, 50)),
    m_rules=(between(1, 0, 500), between(2, 500, 1000), between(3, 1000, 10000), between(4, 10000, 50000), above(5, 50000)),
    segments=(
        SegmentList("VIP", ("555", "455", "355", "345", "354", "445", "245", "255", "325", "335")),
        SegmentList("REGULAR", ("443", "441", "442", "444", "333", "341", "342", "343", "344", "321", "322", "323",
                                "324", "334", "513", "512", "523", "524", "511", "514")),
        SegmentList("HOPEFOOL", ("221", "222", "223", "224", "115", "225", "231", "232", "233", "234", "235", "241",
                                 "242", "243", "244", "251", "252", "253", "254", "311", "312", "313", "314", "315",
                                 "124", "125", "211", "212")),
        SegmentList("LOST", ("111", "112", "113", "114", "121", "122", "123", "134", "144")),
    ),
)

# Two-score behaviour groups: R 3 = within 3 days, 2 = within 30, else 1;
# F 1 = up to 20 orders, 2 = up to 100, else 3.
RF_BASIC = RfProfile(
    name="rf_basic",
    r_rules=(at_most(3, 3), at_most(2, 30)),
    f_rules=(at_most(1, 20), at_most(2, 100)),
    good_name="good_regular_users",
    good_codes=("33", "23", "32", "31", "22", "21"),
    bad_name="bad_regular_users",
    bad_codes=("13",),
    lost_name="lost_users",
    lost_max_orders=3,
    lost_excluded_codes=("31", "21"),
)


def with_bands(profile: RfmProfile, name: str, *, r_rules: Sequence[Rule] | None = None,
               f_rules: Sequence[Rule] | None = None, m_rules: Sequence[Rule] | None = None) -> RfmProfile:
    """Same segment map, other thresholds (e.g. for data of another scale)."""
    return RfmProfile(
        name=name,
        r_rules=tuple(r_rules) if r_rules is not None else profile.r_rules,
        f_rules=tuple(f_rules) if f_rules is not None else profile.f_rules,
        m_rules=tuple(m_rules) if m_rules is not None else profile.m_rules,
        segments=profile.segments,
        default_segment=profile.default_segment,
    )


def rf_with_bands(profile: RfProfile, name: str, r_rules: Sequence[Rule], f_rules: Sequence[Rule]) -> RfProfile:
    return RfProfile(
        name=name, r_rules=tuple(r_rules), f_rules=tuple(f_rules),
        good_name=profile.good_name, good_codes=profile.good_codes,
        bad_name=profile.bad_name, bad_codes=profile.bad_codes,
        lost_name=profile.lost_name, lost_max_orders=profile.lost_max_orders,
        lost_excluded_codes=profile.lost_excluded_codes,
        default_segment=profile.default_segment,
        r_default=profile.r_default, f_default=profile.f_default,
    )


__all__ = [
    "JOURNEY", "MARKET", "RF_BASIC", "RfProfile", "RfmProfile", "SegmentList", "UNDEFINED",
    "all_codes", "rf_with_bands", "with_bands",
]
