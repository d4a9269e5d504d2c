"""Plan shape checks and the SQL oracle on the stored test tables."""

import importlib.util
import os
import re

import pytest

from basketlens.operators import frequent_recent_buyers, last_order_date
from tests.compare import compare, duck_connect
from tests.conftest import SMALL, orders_df
from tools.plan_stats import plan_text

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_contract(spark):
    mod = _entry_module()
    df = mod.entry(spark)
    assert df.count() > 0
    assert set(mod.oracle_sql()) <= set(mod.queries())
    assert "segment" in df.columns and "share_of_turnover" in df.columns


@pytest.fixture(scope="module")
def plans(spark):
    from basketlens.plans import queries

    cat = queries()
    return {name: plan_text(cat[name](spark, SMALL)) for name in cat}


def test_no_python_udf_or_cartesian(plans):
    for name, text in plans.items():
        assert not re.search(r"BatchEvalPython|ArrowEvalPython|PythonUDF", text), name
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name


def test_rfm_reads_orders_once_for_user_measures(plans):
    for name in ("rfm_journey", "rfm_market", "rfm_snapshots"):
        text = plans[name]
        # one scan for the per-user aggregate, one narrow scan for the last date;
        # counts per code / segment and the turnover total reuse the shuffle
        assert text.count("Scan parquet") == 2, name
        assert "ReusedExchange" in text, name


def test_revenue_by_group_and_month_reads_orders_once(plans):
    text = plans["rf_segment_month"]
    assert text.count("Scan parquet") == 2 and "Join" not in text  # the orders, and the date column for the last date


def test_frequent_buyers_aggregate_the_window_once(spark, scratch):
    """Open users (all window rows on the last day) make a filter; the history is read through it."""
    days = [("1", "2017-04-10"), ("2", "2017-04-30"), ("3", "2017-04-30"), ("4", "2016-01-05"), ("5", "2016-02-05")]
    rows = []
    for u in range(300):
        # 0: open with a history, 1: open without one, 2: not open, 3: history only
        kind = u % 4
        rows += [(f"{u}-{i}", str(u), "1", d) for i, d in days if (kind == 0 and i != "1") or (kind == 1 and i in "23") or (kind == 2 and i in "12") or (kind == 3 and i in "45")]
    orders_df(spark, rows).repartition(3).write.parquet(f"{scratch}/orders")
    stored = spark.read.parquet(f"{scratch}/orders")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = frequent_recent_buyers(stored, last_order_date(stored, "2017-05-01"), 30, 1, cutoff="2017-05-01")
        text = plan_text(df)
        found = {int(r.user_id) for r in df.collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert found == {u for u in range(300) if u % 4 in (0, 2)}
    # window rows, history, date of the last order; the window aggregate is used twice
    assert text.count("Scan parquet") == 3 and "ReusedExchange" in text and "Expand" not in text
    full = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert full.count("LessThan(o_date,2017-05-01)") >= 3  # the literal bound reaches every scan


def test_windows_are_partitioned_by_a_high_cardinality_key(spark):
    """Every Window node is partitioned, and only by the user (never by a
    segment, a year or nothing, which would put whole groups in one task)."""
    from basketlens.plans import queries

    cat = queries()
    found = 0
    for name in cat:
        df = cat[name](spark, SMALL)
        df.collect()
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        lines = text.splitlines()
        for i, line in enumerate(lines):
            if re.match(r"\(\d+\) Window\b", line):
                args = next(x for x in lines[i + 1:i + 4] if x.startswith("Arguments:"))
                # Arguments: [window expressions], [partition spec], [order spec]
                partition_spec = args.split("], [")[1]
                assert partition_spec.startswith("user_id#"), (name, args)
                found += 1
    assert found >= 1  # cohort revenue has one


@pytest.mark.parametrize("name", sorted(__import__("basketlens.plans", fromlist=["ORACLE"]).ORACLE))
def test_matches_sql_oracle(spark, name):
    con = duck_connect(SMALL)
    ok, msg = compare(spark, con, name, SMALL)
    assert ok, msg


def test_building_a_query_runs_no_job(spark, monkeypatch):
    """Queries are lazy: constructing them (scalars included) starts no job,
    so nothing is computed or collected on the driver before execution."""
    from basketlens.plans import queries

    # inferring a schema reads a footer in a job; each table's schema is read once, before
    reader, schemas = type(spark.read), {}
    infer = reader.parquet

    def parquet(self, path):
        if path not in schemas:
            schemas[path] = infer(self, path).schema
        return infer(self.schema(schemas[path]), path)

    monkeypatch.setattr(reader, "parquet", parquet)
    cat = queries()
    for name in cat:
        cat[name](spark, SMALL)
    sc = spark.sparkContext
    sc.setJobGroup("build-only", "construct every registered query")
    try:
        for name in cat:
            cat[name](spark, SMALL)
        assert list(sc.statusTracker().getJobIdsForGroup("build-only")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
