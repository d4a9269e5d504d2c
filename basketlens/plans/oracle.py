"""SQL for every registered query, runnable by DuckDB on the same Parquet tables.

Written from the definitions of the results, apart from the Spark plans: one
grouped query per result, score bands as a table joined by range, segment
maps as a table of codes, counts per group as window functions, churn as a
set difference, limits decided on exact decimals.

Across engines: ratios are divisions of doubles with NULL for a zero divisor,
rounded through ``DECIMAL(38,10)`` (HALF_UP); money is summed as ``DECIMAL``
and returned as ``DOUBLE``; counts are ``BIGINT``; years, months and day
differences are ``INTEGER``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

SALE = """sale AS (
  SELECT o_orderkey AS id, o_custkey AS who, o_totalprice::DECIMAL(12,2) AS amount, o_orderdate::DATE AS day,
         year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS mon
  FROM orders)"""

VISITS_PER_DAY = """visits AS (
  SELECT ts::DATE AS day, count(DISTINCT user_id) AS users FROM events WHERE user_id IS NOT NULL GROUP BY ALL)"""

CHANNEL_SALE = """channel_sale AS (
  SELECT c_mktsegment AS channel, o_custkey AS who, year(o_orderdate) AS y, o_totalprice::DECIMAL(12,2) AS amount
  FROM customer JOIN orders ON o_custkey = c_custkey)"""


def two_places(expr: str) -> str:
    return f"round(({expr})::DECIMAL(38,10), 2)::DOUBLE"


def ratio(over: str, under: str) -> str:
    return f"(({over})::DOUBLE / nullif(({under})::DOUBLE, 0))"


# Score bands as (measure, from, to, score) with both ends in,
# the first that fits (days and orders are whole, money has two places), and
# the codes of each segment.
_MOST = 10**15
JOURNEY_R = [("r", 366, _MOST, 1), ("r", 100, 365, 2), ("r", 60, 100, 3), ("r", 30, 60, 4), ("r", -_MOST, 29, 5)]
MARKET_R = [("r", -_MOST, 364, 1), ("r", 100, 365, 2), ("r", 100, 60, 3), ("r", 60, 30, 4), ("r", 31, _MOST, 5)]
JOURNEY_F = [("f", 1, 1, 1), ("f", 2, 10, 2), ("f", 10, 20, 3), ("f", 20, 50, 4), ("f", 51, _MOST, 5)]
MARKET_F = [("f", 1, 2, 1), ("f", 2, 10, 2), ("f", 10, 20, 3), ("f", 20, 50, 4), ("f", 51, _MOST, 5)]
SCALED_F = [("f", 1, 1, 1), ("f", 2, 5, 2), ("f", 5, 8, 3), ("f", 8, 12, 4), ("f", 13, _MOST, 5)]
MONEY = [("m", 0, 500, 1), ("m", 500, 1000, 2), ("m", 1000, 10000, 3), ("m", 10000, 50000, 4), ("m", 50000.01, _MOST, 5)]
SCALED_M = [("m", 0, 500000, 1), ("m", 500000, 1000000, 2), ("m", 1000000, 2000000, 3), ("m", 2000000, 3000000, 4), ("m", 3000000.01, _MOST, 5)]

JOURNEY_CODES = {
    "VIP": "555 455 355 345 354 445 325 335 554 545",
    "NEW": "411 412 413 414 415 421 422 423 424 425 511 512 514 515 521 524 525",
    "CHURNED": "144 145 154 155 244 224 314 245 223 254 255 241 242 313 243 251 252 253 225 231 232 233 234 235",
    "REGULAR": "544 543 533 534 535 454 434 435 531 443 441 442 444 333 341 342 343 344 321 322 323 324 334",
    "HOPEFOOL": "221 222 115 433 311 312 315 124 125 523 513 522",
    "LOST": "111 112 113 114 121 122 123 134 215 214 213 212 211",
}
MARKET_CODES = {
    "VIP": "555 455 355 345 354 445 245 255 325 335",
    "REGULAR": "443 441 442 444 333 341 342 343 344 321 322 323 324 334 513 512 523 524 511 514",
    "HOPEFOOL": "221 222 223 224 115 225 231 232 233 234 235 241 242 243 244 251 252 253 254 311 312 313 314 315 124 125 211 212",
    "LOST": "111 112 113 114 121 122 123 134 144",
}
RF_CODES = {"good_regular_users": "33 23 32 31 22 21", "bad_regular_users": "13"}


def band_table(bands: Iterable[tuple]) -> str:
    rows = ", ".join(f"('{m}', {i}, {lo}, {hi}, {s})" for i, (m, lo, hi, s) in enumerate(bands))
    return f"band(measure, place, lo, hi, score) AS (VALUES {rows})"


def code_table(codes: dict[str, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT unnest(string_split('{text}', ' ')) AS code, '{name}' AS segment" for name, text in codes.items())
    return f"code_map AS ({rows})"


def scored_people(cutoffs: Sequence[str] | None, bands: list, codes: dict[str, str]) -> str:
    """CTEs up to ``person``: one row per cutoff and user with scores and segment."""
    if cutoffs is None:
        ref = "ref AS (SELECT NULL::DATE AS cut, max(day) AS latest FROM sale)"
        inside = "amount > 0"
    else:
        cuts = ", ".join(f"(DATE '{c}')" for c in cutoffs)
        ref = f"ref AS (SELECT cut, max(day) AS latest FROM (VALUES {cuts}) c(cut) JOIN sale ON day < cut GROUP BY cut)"
        inside = "amount > 0 AND day < latest"
    return f"""{SALE},
{ref},
paid AS (SELECT cut, latest, sale.* FROM ref JOIN sale ON {inside}),
turnover AS (SELECT cut, sum(amount) AS total FROM paid GROUP BY cut),
measured AS (
  SELECT cut, who, date_diff('day', max(day), latest) AS days, count(DISTINCT id) AS orders, sum(amount) AS sum_price
  FROM paid WHERE who IS NOT NULL GROUP BY cut, latest, who),
{band_table(bands)},
{code_table(codes)},
placed AS (
  SELECT cut, who, measure, arg_min(score, place) AS score
  FROM (UNPIVOT (SELECT cut, who, days::DECIMAL(30,2) AS r, orders::DECIMAL(30,2) AS f, sum_price::DECIMAL(30,2) AS m FROM measured) ON r, f, m INTO NAME measure VALUE v)
  JOIN band USING (measure) WHERE v BETWEEN lo AND hi GROUP BY ALL),
digits AS (
  SELECT m.cut, m.who, any_value(days) AS days, any_value(orders) AS orders, any_value(sum_price) AS sum_price,
         coalesce(max(score) FILTER (measure = 'r'), 0) AS r, coalesce(max(score) FILTER (measure = 'f'), 0) AS f, coalesce(max(score) FILTER (measure = 'm'), 0) AS m
  FROM measured m LEFT JOIN placed p ON p.who = m.who AND p.cut IS NOT DISTINCT FROM m.cut GROUP BY m.cut, m.who),
person AS (
  SELECT cut, who, days, orders, sum_price, format('R{{}}-F{{}}-M{{}}', r, f, m) AS rfm_code, coalesce(segment, 'undefined_group') AS segment
  FROM digits LEFT JOIN code_map ON code = concat(r, f, m))"""


def rfm_table(cutoffs: Sequence[str] | None, bands: list, codes: dict[str, str], snapshot: bool = False) -> str:
    return f"""WITH {scored_people(cutoffs, bands, codes)}
SELECT {'person.cut AS snapshot, ' if snapshot else ''}segment, who AS user_id, rfm_code,
       count(*) OVER (PARTITION BY person.cut, rfm_code) AS count_by_rfm,
       count(*) OVER (PARTITION BY person.cut, segment) AS count_by_group,
       days::INTEGER AS days, orders, sum_price::DOUBLE AS sum_price,
       {two_places(ratio('sum_price', 'total'))} AS share_of_turnover
FROM person JOIN turnover ON turnover.cut IS NOT DISTINCT FROM person.cut"""


SCALED = (JOURNEY_R + SCALED_F + SCALED_M, JOURNEY_CODES)
MONTHLY = [f"{y}-{m:02d}-01" for y in (1998, 1999, 2000) for m in range(1, 13)]
SNAPSHOTS = ("2000-01-01", "2000-02-01", "2000-03-01")


def behaviour_groups(cutoff: str, fresh: int, recent: int, few: int, some: int) -> str:
    """CTEs up to ``grouped``: recency 3 to 1 and frequency 1 to 3 of each user, by range."""
    bands = [("r", -_MOST, fresh, 3), ("r", fresh + 1, recent, 2), ("r", recent + 1, _MOST, 1), ("f", 0, few, 1), ("f", few + 1, some, 2), ("f", some + 1, _MOST, 3)]
    return f"""{SALE},
ref AS (SELECT max(day) AS latest FROM sale WHERE day < DATE '{cutoff}'),
past AS (SELECT sale.* FROM sale JOIN ref ON day < latest),
{band_table(bands)},
{code_table(RF_CODES)},
measured AS (
  SELECT who, date_diff('day', max(day), (SELECT latest FROM ref))::INTEGER AS days, count(DISTINCT id) AS orders
  FROM past WHERE who IS NOT NULL GROUP BY who),
grouped AS (
  SELECT who AS user_id, days, orders, concat(r.score, f.score) AS rf_code,
         coalesce(segment, CASE WHEN orders < 3 THEN 'lost_users' ELSE 'undefined_group' END) AS segment
  FROM measured
  JOIN band r ON r.measure = 'r' AND days BETWEEN r.lo AND r.hi
  JOIN band f ON f.measure = 'f' AND orders BETWEEN f.lo AND f.hi
  LEFT JOIN code_map ON code = concat(r.score, f.score))"""


LATEST_1997 = "(SELECT max(day) FROM sale WHERE day < DATE '1997-05-01')"


def above_limit(threshold: int, per_client: bool) -> str:
    spent = "sum(o_totalprice::DECIMAL(12,2))" if per_client else "o_totalprice::DECIMAL(12,2)"
    return f"""SELECT c_custkey AS id_client, lim::DOUBLE AS limit_sum, spent::DOUBLE AS spent,
       {two_places(ratio('spent', 'lim') + ' * 100')} AS used_pct
FROM (SELECT o_custkey, {spent} AS spent FROM orders {'GROUP BY o_custkey' if per_client else ''})
JOIN (SELECT c_custkey, c_acctbal::DECIMAL(12,2) AS lim FROM customer) ON o_custkey = c_custkey
WHERE sign(lim) * spent * 100 > sign(lim) * {threshold} * lim"""


LOST_1999 = f"""WITH {SALE}
SELECT who AS user_id FROM sale WHERE who IS NOT NULL AND y = 1999
EXCEPT SELECT who FROM sale WHERE y = 2000"""

ORACLE: dict[str, str] = {
    "order_period": f"""WITH {SALE}
SELECT min(day) AS period_from, max(day) AS period_to, date_diff('day', min(day), max(day))::INTEGER AS period_days FROM sale""",
    "order_period_rows": f"WITH {SALE} SELECT DISTINCT unnest([min(day), max(day)]) AS period_from_to FROM sale",
    "order_volume": f"WITH {SALE} SELECT count(*) AS number_rows, count(DISTINCT id) AS unique_order_ids, count(DISTINCT who) AS unique_user_ids FROM sale",
    "avg_check_rows": f"WITH {SALE} SELECT y AS year, mon AS month, {two_places(ratio('sum(amount)', 'count(amount)'))} AS average FROM sale GROUP BY ALL",
    "avg_check_orders": f"""WITH {SALE},
receipt AS (SELECT min(day) AS day, round({ratio('sum(amount)', 'count(amount)')}::DECIMAL(38,10), 2) AS paid FROM sale GROUP BY id)
SELECT year(day)::INTEGER AS year, month(day)::INTEGER AS month, {two_places(ratio('sum(paid)', 'count(paid)'))} AS average_check
FROM receipt GROUP BY ALL""",
    "orders_per_user_year": f"""WITH {SALE}
SELECT y AS year, {two_places(ratio('count(*)', "count(DISTINCT who)"))} AS average_orders FROM sale WHERE who IS NOT NULL GROUP BY y""",
    "orders_per_user_month": f"""WITH {SALE}
SELECT y AS year, mon AS month, {two_places(ratio('count(*)', "count(DISTINCT who)"))} AS average_orders FROM sale WHERE who IS NOT NULL GROUP BY y, mon""",
    "churned_users": LOST_1999,
    "churned_user_count": f"SELECT count(*) AS churned_users FROM ({LOST_1999})",
    "most_active_users": f"""WITH {SALE}
SELECT who AS user_id, count(DISTINCT id) AS orders_amount FROM sale WHERE who IS NOT NULL
GROUP BY who QUALIFY row_number() OVER (ORDER BY orders_amount DESC, who) <= 10""",
    "seasonality": f"""WITH {SALE},
counted AS (SELECT y, mon, count(DISTINCT id) AS n FROM sale WHERE y IS NOT NULL GROUP BY GROUPING SETS ((y, mon), (y)))
SELECT y AS year, mon AS month, {two_places(ratio('n', 'max(n) FILTER (mon IS NULL) OVER (PARTITION BY y)'))} AS seasonal_factor
FROM counted QUALIFY mon IS NOT NULL""",
    "rf_segments": f"WITH {behaviour_groups('2000-01-01', 3, 30, 20, 100)}\nFROM grouped",
    "rf_segments_scaled": f"WITH {behaviour_groups('2000-01-01', 30, 180, 5, 10)}\nFROM grouped",
    "rf_segment_month": f"""WITH {behaviour_groups('2000-01-01', 30, 180, 5, 10)}
SELECT segment, strftime(day, '%y%m') AS period, sum(amount)::DOUBLE AS sum_price, count(DISTINCT who) AS users
FROM past LEFT JOIN grouped ON who = user_id GROUP BY ALL""",
    "user_cohorts": f"""WITH {SALE}
SELECT who AS user_id, strftime(min(day), '%y%m') AS cohort FROM sale WHERE who IS NOT NULL AND day < {LATEST_1997} GROUP BY who""",
    "cohort_revenue": f"""WITH {SALE},
dated AS (SELECT day, amount, min(day) FILTER (day < {LATEST_1997}) OVER (PARTITION BY who) AS joined FROM sale WHERE who IS NOT NULL)
SELECT strftime(joined, '%y%m') AS cohort, strftime(day, '%y%m') AS period, sum(amount)::DOUBLE AS sum_price
FROM dated WHERE joined IS NOT NULL GROUP BY ALL""",
    "active_users": f"WITH {SALE} SELECT who AS user_id FROM sale WHERE who IS NOT NULL GROUP BY who HAVING max(day) >= {LATEST_1997}",
    "active_users_before": f"WITH {SALE} SELECT who AS user_id FROM sale WHERE who IS NOT NULL GROUP BY who HAVING min(day) < {LATEST_1997}",
    "frequent_recent_buyers": f"""WITH {SALE},
near AS (SELECT *, date_diff('day', day, {LATEST_1997}) AS age FROM sale WHERE who IS NOT NULL AND day <= {LATEST_1997})
SELECT who AS user_id,
       {two_places(ratio('count(DISTINCT id) FILTER (age < 365)', 'count(DISTINCT day) FILTER (age < 365)'))} AS frequency,
       min(day) FILTER (age < 365) AS first_date, count(*) FILTER (age < 365) AS order_rows
FROM near GROUP BY who HAVING max(age) > 0 AND count(*) FILTER (age < 365) > 2""",
    "rfm_market": rfm_table(None, MARKET_R + MARKET_F + MONEY, MARKET_CODES),
    "rfm_journey": rfm_table(["2000-01-01"], JOURNEY_R + JOURNEY_F + MONEY, JOURNEY_CODES),
    "rfm_journey_scaled": rfm_table(["2000-01-01"], *SCALED),
    "rfm_code_counts": f"WITH {scored_people(['2000-01-01'], *SCALED)}\nSELECT rfm_code, count(*) AS users FROM person GROUP BY ALL",
    "rfm_group_rollup": f"""WITH {scored_people(['2000-01-01'], *SCALED)}
SELECT segment, count(*) AS users FROM person GROUP BY ALL UNION ALL SELECT 'TOTAL', count(*) FROM person""",
    "paying_users": f"WITH {SALE} SELECT count(DISTINCT who) AS paying_users FROM sale WHERE amount > 0",
    "rfm_snapshots": rfm_table(SNAPSHOTS, *SCALED, snapshot=True),
    "segment_sizes": f"WITH {scored_people(SNAPSHOTS, *SCALED)}\nSELECT cut AS snapshot, segment, count(*) AS count_by_group FROM person GROUP BY ALL",
    "segment_sizes_monthly": f"WITH {scored_people(MONTHLY, *SCALED)}\nSELECT cut AS snapshot, segment, count(*) AS count_by_group FROM person GROUP BY ALL",
    "segment_sizes_subset": f"""WITH {scored_people(SNAPSHOTS, *SCALED)}
SELECT cut AS snapshot, segment, count(*) AS count_by_group FROM person WHERE segment IN ('VIP', 'undefined_group') GROUP BY ALL""",
    "transaction_totals": f"""SELECT count(*) AS transactions_count, sum(amount)::DOUBLE AS transactions_sum,
       {two_places(ratio('sum(amount)', 'count(amount)'))} AS transactions_average
FROM (SELECT o_totalprice::DECIMAL(12,2) AS amount FROM orders)""",
    "first_transaction": """SELECT c_custkey AS id_client, (SELECT min(date_trunc('second', ts)) FROM events WHERE user_id = c_custkey)::TIMESTAMP AS "datetime" FROM customer""",
    "limit_utilisation": above_limit(70, per_client=False),
    "limit_utilisation_high": above_limit(20000, per_client=False),
    "limit_utilisation_client": above_limit(70, per_client=True),
    "peak_traffic_day": f"WITH {VISITS_PER_DAY} SELECT dayname(day) AS dayname, day, users FROM visits QUALIFY rank() OVER (ORDER BY users DESC) = 1",
    "traffic_by_weekday": f"WITH {VISITS_PER_DAY} SELECT dayname(day) AS dayname, sum(users)::BIGINT AS users, count(*) AS days FROM visits GROUP BY dayname(day)",
    "top_channels_traffic": """SELECT event_type AS channel, count(DISTINCT user_id) AS users
FROM events WHERE year(ts) = 2024 AND user_id IS NOT NULL GROUP BY event_type
QUALIFY row_number() OVER (ORDER BY users DESC, channel) <= 3""",
    "channel_users_sketched": """SELECT event_type AS channel, year(ts)::INTEGER AS year, count(DISTINCT user_id) AS users, true AS within_bound
FROM events WHERE ts IS NOT NULL GROUP BY ALL""",
    "top_channels_revenue": f"""WITH {CHANNEL_SALE},
earned AS (SELECT channel, sum(amount) AS revenue FROM channel_sale WHERE y = 2000 GROUP BY channel)
SELECT channel, revenue::DOUBLE AS revenue, {two_places(ratio('revenue', 'sum(revenue) OVER ()') + ' * 100')} AS share_pct
FROM earned QUALIFY row_number() OVER (ORDER BY earned.revenue DESC, channel) <= 3""",
    "channel_growth": f"""WITH {CHANNEL_SALE},
reach AS (
  SELECT channel, count(DISTINCT who) FILTER (y = 2000) AS users, count(DISTINCT who) FILTER (y = 1999) AS prev_users
  FROM channel_sale WHERE y IN (1999, 2000) GROUP BY channel)
SELECT channel, users, prev_users, {two_places(ratio('users - prev_users', 'prev_users') + ' * 100')} AS growth_pct
FROM reach QUALIFY row_number() OVER (ORDER BY growth_pct DESC NULLS LAST, channel) = 1""",
    "ingest_orders": """SELECT o_orderkey::VARCHAR AS id_o, o_custkey::VARCHAR AS user_id,
       round(o_totalprice::DECIMAL(12,2), 1)::DOUBLE AS price, o_orderdate::DATE AS o_date
FROM orders WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL""",
    "ingest_daily_traffic": f"WITH {VISITS_PER_DAY} SELECT day, users::INTEGER AS users FROM visits WHERE day IS NOT NULL",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
