"""Parameters of the registered queries on the star-schema test tables.

The fixed profiles (``JOURNEY``, ``MARKET``, ``RF_BASIC``) keep their
thresholds.  On the test tables their money bands put nearly every user in
the top band (order totals reach millions) and the RF frequency bands put
nearly every user in F 1, so scaled variants with the same segment maps and
rules are run as well; they fill every score.
"""

from __future__ import annotations

import datetime as dt

from basketlens.functions.bands import above, at_most, between, equal
from basketlens.functions.profiles import JOURNEY, MARKET, RF_BASIC, rf_with_bands, with_bands

# Cutoffs
RFM_CUTOFF = dt.date(2000, 1, 1)
SNAPSHOT_CUTOFFS = (dt.date(2000, 1, 1), dt.date(2000, 2, 1), dt.date(2000, 3, 1))
MONTHLY_CUTOFFS = tuple(dt.date(y, m, 1) for y in (1998, 1999, 2000) for m in range(1, 13))
RF_CUTOFF = dt.date(2000, 1, 1)
COHORT_CUTOFF = dt.date(1997, 5, 1)
RECENT_WINDOW_DAYS = 365
RECENT_MIN_ROWS = 2
CHURN_YEAR = 1999
CHANNEL_YEAR = 2000
CHANNEL_PREV_YEAR = 1999
TRAFFIC_YEAR = 2024
TOP_USERS = 10
TOP_CHANNELS = 3
LIMIT_THRESHOLD = 70
LIMIT_THRESHOLD_HIGH = 20000
SNAPSHOT_GROUPS = ("VIP", "undefined_group")

JOURNEY_SCALED = with_bands(
    JOURNEY,
    "journey_scaled",
    f_rules=(equal(1, 1), between(2, 2, 5), between(3, 5, 8), between(4, 8, 12), above(5, 12)),
    m_rules=(
        between(1, 0, 500_000),
        between(2, 500_000, 1_000_000),
        between(3, 1_000_000, 2_000_000),
        between(4, 2_000_000, 3_000_000),
        above(5, 3_000_000),
    ),
)

RF_SCALED = rf_with_bands(
    RF_BASIC,
    "rf_scaled",
    r_rules=(at_most(3, 30), at_most(2, 180)),
    f_rules=(at_most(1, 5), at_most(2, 10)),
)

__all__ = [
    "CHANNEL_PREV_YEAR", "CHANNEL_YEAR", "CHURN_YEAR", "COHORT_CUTOFF", "JOURNEY", "JOURNEY_SCALED",
    "LIMIT_THRESHOLD", "LIMIT_THRESHOLD_HIGH", "MARKET", "MONTHLY_CUTOFFS", "RECENT_MIN_ROWS",
    "RECENT_WINDOW_DAYS", "RF_CUTOFF", "RF_SCALED", "RFM_CUTOFF", "SNAPSHOT_CUTOFFS",
    "SNAPSHOT_GROUPS", "TOP_CHANNELS", "TOP_USERS", "TRAFFIC_YEAR",
]
