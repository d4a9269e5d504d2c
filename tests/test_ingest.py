"""Parsing, quarantine and CSV loading (S1, S2, P1-P6)."""

import datetime as dt
import decimal
import os
import re

import pytest

from basketlens.operators import peak_traffic_days, traffic_by_weekday
from basketlens.plans.round_trip import format_orders_text
from basketlens.sources import order_log
from basketlens.sources.ingest import (
    ORDERS_TYPED,
    drop_load,
    ingest_orders_table,
    load_daily_traffic,
    load_orders,
    parse_daily_traffic,
    parse_decimal_comma,
    parse_grouped_int,
    parse_orders,
)

NBSP = "\u00a0"

RAW_TRAFFIC = [
    ("07.12.2020", f"3{NBSP}465"),
    ("08.12.2020", f"3{NBSP}715"),
    ("09.12.2020", f"3{NBSP}396"),
    ("22.03.2020", "979"),
    ("", "5"),
    ("1.2.2020", ""),
    ("31.02.2020", "7"),
]

RAW_ORDERS = [
    ("1", "10", "12,25", "01.02.2016"),
    ("2", "10", "x", "01.02.2016"),
    ("12345678", "10", "1,0", "01.02.2016"),
]


def test_parse_orders_and_quarantine(spark):
    raw = spark.createDataFrame(RAW_ORDERS, "id_o string, user_id string, price string, o_date string")
    res = parse_orders(raw, id_max_length=7)
    good = res.good.collect()
    assert [tuple(r) for r in good] == [("1", "10", decimal.Decimal("12.3"), dt.date(2016, 2, 1))]
    rejected = {r["id_o"]: r["reject_reason"] for r in res.rejected.collect()}
    assert rejected == {"2": "bad price", "12345678": "id_o too long"}
    assert str(res.good.schema["price"].dataType) == "DecimalType(10,1)"


def test_parse_orders_without_length_check(spark):
    raw = spark.createDataFrame(RAW_ORDERS, "id_o string, user_id string, price string, o_date string")
    res = parse_orders(raw)  # no length check by default
    assert sorted(r["id_o"] for r in res.good.collect()) == ["1", "12345678"]


def test_parse_daily_traffic(spark):
    raw = spark.createDataFrame(RAW_TRAFFIC, "day string, users string")
    res = parse_daily_traffic(raw)
    good = {r["day"]: r["users"] for r in res.good.collect()}
    assert good == {
        dt.date(2020, 12, 7): 3465,
        dt.date(2020, 12, 8): 3715,
        dt.date(2020, 12, 9): 3396,
        dt.date(2020, 3, 22): 979,
        dt.date(2020, 2, 1): 0,
    }
    rejected = res.rejected.collect()
    assert [(r["day"], r["reject_reason"]) for r in rejected] == [("31.02.2020", "bad day")]


def test_golden_peak_day_is_tuesday(spark):
    daily = parse_daily_traffic(spark.createDataFrame(RAW_TRAFFIC, "day string, users string")).good
    rows = peak_traffic_days(daily).collect()
    assert [(r["dayname"], r["day"], r["users"]) for r in rows] == [("Tuesday", dt.date(2020, 12, 8), 3715)]


def test_peak_day_keeps_ties(spark):
    daily = spark.createDataFrame(
        [(dt.date(2020, 1, 6), 5), (dt.date(2020, 1, 7), 9), (dt.date(2020, 1, 8), 9)], "day date, users int"
    )
    rows = sorted((r["dayname"], r["users"]) for r in peak_traffic_days(daily).collect())
    assert rows == [("Tuesday", 9), ("Wednesday", 9)]
    by_day = {r["dayname"]: r["users"] for r in traffic_by_weekday(daily).collect()}
    assert by_day == {"Monday": 5, "Tuesday": 9, "Wednesday": 9}


def test_load_orders_csv(spark, scratch):
    path = os.path.join(scratch, "orders.csv")
    with open(path, "w", newline="") as fh:
        fh.write('"id_o";"user_id";"price";"o_date"\r\n')
        fh.write("1;10;12,25;01.02.2016\r\n")
        fh.write("2;11;7,5;3.2.2016\r\n")
        fh.write("3;12;abc;04.02.2016\r\n")
    res = load_orders(spark, path)
    good = sorted(tuple(r) for r in res.good.collect())
    assert good == [
        ("1", "10", decimal.Decimal("12.3"), dt.date(2016, 2, 1)),
        ("2", "11", decimal.Decimal("7.5"), dt.date(2016, 2, 3)),
    ]
    assert res.rejected.count() == 1
    with pytest.raises(ValueError):
        load_orders(spark, path, on_error="fail")


def test_load_daily_traffic_csv(spark, scratch):
    path = os.path.join(scratch, "traffic.csv")
    with open(path, "w", encoding="utf-8", newline="") as fh:
        fh.write("day,users\n")
        for day, users in RAW_TRAFFIC:
            fh.write(f"{day},{users}\n")
    res = load_daily_traffic(spark, path)
    assert res.good.count() == 5
    assert res.rejected.count() == 1
    assert dict((r["day"], r["users"]) for r in res.good.collect())[dt.date(2020, 12, 8)] == 3715


def test_orders_text_round_trip(spark):
    from tests.conftest import orders_df

    o = orders_df(spark, [("1", "7", "12.25", "2016-02-01"), ("2", "7", "3.00", "2016-12-31")])
    back = parse_orders(format_orders_text(o)).good.collect()
    assert sorted(tuple(r) for r in back) == [
        ("1", "7", decimal.Decimal("12.3"), dt.date(2016, 2, 1)),
        ("2", "7", decimal.Decimal("3.0"), dt.date(2016, 12, 31)),
    ]


def test_ingest_jobs_store_good_and_rejected(spark, scratch):
    from basketlens.sources.ingest import ingest_daily_traffic_table, ingest_orders_table

    path = os.path.join(scratch, "orders.csv")
    with open(path, "w", newline="") as fh:
        fh.write('"id_o";"user_id";"price";"o_date"\r\n')
        for row in RAW_ORDERS:
            fh.write(";".join(row) + "\r\n")
    res = ingest_orders_table(spark, path, os.path.join(scratch, "orders_table"), id_max_length=7)
    assert [tuple(r) for r in res.good.collect()] == [("1", "10", decimal.Decimal("12.3"), dt.date(2016, 2, 1))]
    assert sorted((r["id_o"], r["price"], r["reject_reason"]) for r in res.rejected.collect()) == [
        ("12345678", "1,0", "id_o too long"), ("2", "x", "bad price")]
    tpath = os.path.join(scratch, "traffic.csv")
    with open(tpath, "w", encoding="utf-8", newline="") as fh:
        fh.write("day,users\n")
        for day, users in RAW_TRAFFIC:
            fh.write(f"{day},{users}\n")
    tres = ingest_daily_traffic_table(spark, tpath, os.path.join(scratch, "traffic_table"))
    assert tres.good.count() == 5 and tres.rejected.count() == 1
    assert str(tres.good.schema["users"].dataType) == "IntegerType()"


def test_ingest_append_adds_a_new_export(spark, scratch):
    from basketlens.sources.ingest import ingest_daily_traffic_table

    table = os.path.join(scratch, "traffic_table")
    for i, rows in enumerate((RAW_TRAFFIC[:3], RAW_TRAFFIC[3:])):
        path = os.path.join(scratch, f"day{i}.csv")
        with open(path, "w", encoding="utf-8", newline="") as fh:
            fh.write("day,users\n")
            for day, users in rows:
                fh.write(f"{day},{users}\n")
        res = ingest_daily_traffic_table(spark, path, table, mode="append" if i else "overwrite")
    assert res.good.count() == 5 and res.rejected.count() == 1


def _orders_file(scratch, name, *lines):
    path = os.path.join(scratch, name)
    with open(path, "w", newline="") as fh:
        fh.write("\r\n".join(lines) + "\r\n")
    return path


def test_columns_are_taken_by_name(spark, scratch):
    path = _orders_file(scratch, "swapped.csv", '"User_ID ";"id_o";o_date;price', "10;1;01.02.2016;12,25")
    assert [tuple(r) for r in load_orders(spark, path).good.collect()] == [("1", "10", decimal.Decimal("12.3"), dt.date(2016, 2, 1))]
    for header in ("id_o;user_id;price", "id_o;user_id;price;o_date;extra", "id;user_id;price;o_date"):
        with pytest.raises(ValueError, match="header"):
            load_orders(spark, _orders_file(scratch, f"{len(header)}.csv", header, "1;2;3;4"))


def test_lines_with_other_numbers_of_fields_are_rejected(spark, scratch):
    path = _orders_file(scratch, "fields.csv", "id_o;user_id;price;o_date", "12345678;2;1,0;01.02.2016", "2;2;1,0;01.02.2016;more", "3;2;1,0", "4;2;99999999999,0;01.02.2016")
    res = load_orders(spark, path)
    assert [r["id_o"] for r in res.good.collect()] == ["12345678"]
    assert res.good.count() == 1
    assert sorted((r["reject_reason"], r["raw_line"]) for r in res.rejected.collect() if r["raw_line"]) == [
        ("wrong number of fields", "2;2;1,0;01.02.2016;more"), ("wrong number of fields", "3;2;1,0")]
    assert [r["id_o"] for r in res.rejected.collect() if r["reject_reason"] == "price out of range"] == ["4"]
    raw = spark.createDataFrame([("4", "2", "99999999999,0", "01.02.2016")], "id_o string, user_id string, price string, o_date string")
    assert parse_orders(raw, price_type="decimal(14,1)").good.count() == 1


def test_loading_again_replaces_everything(spark, scratch):
    from basketlens.sources.ingest import ingest_orders_table

    head, good, bad = "id_o;user_id;price;o_date", "1;10;1,0;01.02.2016", "2;10;x;01.02.2016"
    dest = os.path.join(scratch, "again")
    counts = []
    for i, lines in enumerate([(good, bad), (good,), (bad,)]):
        res = ingest_orders_table(spark, _orders_file(scratch, f"load{i}.csv", head, *lines), dest)
        counts.append((res.good.count(), res.rejected.count()))
    assert counts == [(1, 1), (1, 0), (0, 1)]


def test_compatibility_digits_are_read_as_nfkd(spark):
    import unicodedata

    from basketlens.functions.numeric import compatibility_digits

    chars, plain = compatibility_digits()
    assert all(unicodedata.normalize("NFKD", c) == p for c, p in zip(chars, plain)) and len(chars) > 100
    texts = ["\uff11\uff12\uff0c\uff15", "\u00b2\u2075", "\U0001d7d9\U0001d7ec,\U0001d7ff", f"3{NBSP}715", "\u2460\u00b9", "1\u2009000", "x\u00b2"]
    raw = spark.createDataFrame([(t, t) for t in texts], "price string, users string")
    got = raw.select(parse_decimal_comma(raw.price, "decimal(20,2)"), parse_grouped_int(raw.users)).collect()
    for text, (price, users) in zip(texts, got):
        form = unicodedata.normalize("NFKD", text)
        number = form.replace(",", ".").strip()
        assert price == (decimal.Decimal(number) if re.fullmatch(r"[\d.]+", number) else None), text
        whole = form.replace(" ", "")
        assert users == (int(whole) if whole.isdigit() else None), text


def test_rejected_rows_name_their_file(spark, scratch):
    os.makedirs(f"{scratch}/in")
    for name, bad in (("a", "x"), ("b", "y")):
        with open(f"{scratch}/in/{name}.csv", "w") as f:
            f.write(f"id_o;user_id;price;o_date\n1;10;1,5;01.02.2016\n{name};11;{bad};01.02.2016\n2;3\n")
    for found in (load_orders(spark, f"{scratch}/in"), ingest_orders_table(spark, f"{scratch}/in", f"{scratch}/t", load="one")):
        rejected = found.rejected.collect()
        assert sorted((os.path.basename(r.source_file), r.price) for r in rejected if r.price) == [("a.csv", "x"), ("b.csv", "y")]
        assert sorted((os.path.basename(r.source_file), r.raw_line) for r in rejected if not r.price) == [("a.csv", "2;3"), ("b.csv", "2;3")]
        assert all(r.block_start == 0 for r in rejected)
        assert found.good.columns == ["id_o", "user_id", "price", "o_date"] and found.good.count() == 2


def test_loads_are_replaced_and_taken_back(spark, scratch):
    def export(name, *prices):
        with open(f"{scratch}/{name}.csv", "w") as f:
            f.write("id_o;user_id;price;o_date\n" + "".join(f"{i};10;{p};01.02.2016\n" for i, p in enumerate(prices)))
        return f"{scratch}/{name}.csv"

    def state(found):
        return sorted(float(r.price) for r in found.good.collect()), sorted(r.price for r in found.rejected.collect())

    table = f"{scratch}/table"
    first, second = export("one", "1,0", "2,0", "x"), export("two", "3,0")
    assert state(ingest_orders_table(spark, first, table, load="2016-02")) == ([1.0, 2.0], ["x"])
    for _ in range(2):
        assert state(ingest_orders_table(spark, second, table, load="2016-03")) == ([1.0, 2.0, 3.0], ["x"])
    # a corrected export: its rows and its rejected rows replace the first ones
    assert state(ingest_orders_table(spark, export("corrected", "1,0", "2,5"), table, load="2016-02")) == ([1.0, 2.5, 3.0], [])
    drop_load(spark, table, "2016-03", ORDERS_TYPED)
    again = ingest_orders_table(spark, first, table, load="2016-02")
    assert state(again) == ([1.0, 2.0], ["x"])
    with pytest.raises(ValueError):
        ingest_orders_table(spark, first, table, load="../x")


def test_price_type_of_the_jobs(spark, scratch):
    with open(f"{scratch}/o.csv", "w") as f:
        f.write("id_o;user_id;price;o_date\n1;10;12345678901,55;01.02.2016\n")
    for found in (load_orders(spark, f"{scratch}/o.csv", price_type="decimal(14,2)"), ingest_orders_table(spark, f"{scratch}/o.csv", f"{scratch}/t", price_type="decimal(14,2)")):
        assert [r.price for r in found.good.collect()] == [decimal.Decimal("12345678901.55")]
    assert load_orders(spark, f"{scratch}/o.csv").rejected.first().reject_reason == "price out of range"
    wide = spark.createDataFrame([(1, 2, 12345678901.5, dt.datetime(2020, 1, 1))], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz")
    assert order_log(wide, "decimal(14,2)").first().price == decimal.Decimal("12345678901.50")
