"""Physical-plan properties that must hold for every report at any scale."""

import re

import pytest

import __spark_entry__ as E

from tradewind.plans import REPORTS  # noqa: E402

NAMES = list(REPORTS)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_pairwise_or_python_operators(spark, sf_small, name):
    plan = _plan(E.queries()[name](spark, sf_small))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                "FlatMapGroupsInPandas", "MapInPandas"):
        assert bad not in plan, f"{name}: {bad}"
    # every window is partitioned (an unpartitioned window moves all rows into one task)
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            assert not re.search(r"\], \[\], \[", line), f"{name}: unpartitioned window: {line.strip()[:200]}"


def test_trailing_window_reaches_the_scan(spark, sf_small):
    plan = _plan(E.queries()["sell_in_trailing"](spark, sf_small))
    scans = [line for line in plan.splitlines() if "lineitem.parquet" in line]
    assert any(re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_shipdate", s) for s in scans)


def _formatted(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_scans_read_only_needed_columns(spark, sf_small):
    text = _formatted(E.queries()["inbound_buckets"](spark, sf_small))
    block = text[text.index("lineitem.parquet"):]
    read = re.search(r"ReadSchema: struct<([^>]*)>", block).group(1)
    cols = {c.split(":")[0] for c in read.split(",")}
    assert cols == {"l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_shipdate"}


def _pushed(df):
    text = _formatted(df)
    return [re.search(r"PushedFilters: (\[.*\])", block).group(1) for block in text.split("lineitem.parquet")[1:] if "PushedFilters" in block.split("\n\n")[0]]


@pytest.mark.parametrize("name", ["sell_through", "latest_week_onhand", "lead_forecast"])
def test_windows_on_derived_dates_reach_the_scan(spark, sf_small, name):
    assert any("l_shipdate" in p and "GreaterThanOrEqual" in p for p in _pushed(E.queries()[name](spark, sf_small)))


def _no_broadcast(spark, on):
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1") if on else spark.conf.unset(key)
    spark.conf.set("spark.sql.adaptive.enabled", "false" if on else "true")


@pytest.mark.parametrize("name, most", [("sell_through", 1), ("anchored_outer_merge", 7), ("marketing_dashboard", 7),
                                        ("net_revenue_by_account", 4), ("lifecycle_class", 1)])
def test_scans_of_the_fact_table(spark, sf_small, name, most):
    """Without a folder for intermediate tables the whole report is one plan; scans behind a reused
    exchange do not run again."""
    _no_broadcast(spark, True)
    try:
        lines = _plan(E.queries()[name](spark, sf_small)).splitlines()
    finally:
        _no_broadcast(spark, False)
    assert 1 <= sum("lineitem.parquet" in line for line in lines) <= most


def test_scans_with_stored_intermediates(spark, sf_small, tmp_path):
    from tradewind.plans import FIXTURE
    from tradewind.sources import Warehouse
    wh = Warehouse(spark, sf_small, store_dir=f"file://{tmp_path}")
    df = REPORTS["marketing_dashboard"](wh, FIXTURE)
    assert "lineitem.parquet" not in _plan(df) and df.count() == E.queries()["marketing_dashboard"](spark, sf_small).count()
    wh.close()
    assert not any(tmp_path.iterdir())


def test_no_machine_local_folder_in_the_library():
    import pathlib

    import tradewind
    for p in pathlib.Path(tradewind.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "mkdtemp" not in p.read_text(), p


def test_calendar_join_does_not_shuffle_the_sales_on_dates(spark, sf_small):
    plan = _plan(E.queries()["sales_with_season"](spark, sf_small))
    assert not re.search(r"Exchange hashpartitioning\(transaction_dt", plan)


def test_only_bounded_explicit_broadcast(spark, sf_small):
    # the single explicit broadcast is the one-row latest-week maximum
    df = E.queries()["latest_week_onhand"](spark, sf_small)
    hints = df._jdf.queryExecution().analyzed().toString()
    assert hints.count("broadcast") <= 1


def test_lead_month_filter_runs_before_the_fact_joins(spark, sf_small):
    df = E.queries()["lead_forecast"](spark, sf_small)
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    fact_join = min(i for i, line in enumerate(lines) if "Join Inner, (l_orderkey" in line)
    lead_filter = [i for i, line in enumerate(lines) if "Filter" in line and "add_months" in line]
    # printed below the lineitem-orders join means evaluated on lineitem rows before it
    assert lead_filter and min(lead_filter) > fact_join
