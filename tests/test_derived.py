"""Bounds on derived dates reach the stored date, lose no row, and follow the data where it leaves the declared reach."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tradewind.plans import FIXTURE, REPORTS, present
from tradewind.sources import StoredWarehouse, Warehouse, save_roles
from tradewind.sources import derived as D
from tradewind.sources.roles import DERIVED, season_dates


def _pushed(df, table):
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    found = [re.search(r"PushedFilters: (\[.*\])", b.split("\n\n")[0]) for b in text.split(table)[1:]]
    return [m.group(1) for m in found if m]


BOTH, LOWER = ("GreaterThanOrEqual(l_shipdate", "LessThan(l_shipdate"), ("GreaterThanOrEqual(l_shipdate",)


@pytest.mark.parametrize("name, sides", [
    ("bulk_buckets", BOTH), ("lead_forecast", BOTH), ("inline_status", BOTH), ("sheet_rollup", BOTH),
    ("sales_with_season", LOWER), ("order_type_pivot", LOWER), ("current_forecast", LOWER), ("sell_through", LOWER)])
def test_bounds_reach_the_scan_of_the_lines(spark, sf_small, name, sides):
    pushed = _pushed(REPORTS[name](Warehouse(spark, sf_small), FIXTURE), "lineitem.parquet")
    assert any(all(s in p for s in sides) for p in pushed), pushed


def test_every_read_of_the_lines_is_bounded_where_all_are_derived(spark, sf_small):
    for name in ("sales_with_season", "current_forecast"):
        pushed = _pushed(REPORTS[name](Warehouse(spark, sf_small), FIXTURE), "lineitem.parquet")
        assert pushed and all("l_shipdate" in p.replace("IsNotNull(l_shipdate)", "") for p in pushed), pushed


def _lines_reader(spark, sf, odd):
    """The tables with odd rows: line numbers out of the declared reach, NULL dates and numbers."""
    def read(s, name):
        df = s.read.parquet(f"{sf}/{name}.parquet")
        if name != "lineitem" or not odd:
            return df
        pick = F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_suppkey"), F.lit(6))
        kind = df.schema["l_linenumber"].dataType
        number = F.when(pick == 0, F.lit(60)).when(pick == 1, F.lit(-9)).when(pick == 2, F.lit(None)).otherwise(F.col("l_linenumber"))
        date = F.when(pick == 3, F.lit(None)).otherwise(F.col("l_shipdate"))
        return df.withColumn("l_linenumber", number.cast(kind)).withColumn("l_shipdate", date)
    return read


ALL = [(role, column) for role, columns in DERIVED.items() for column in columns if role != "selected_snapshots"]


@pytest.mark.parametrize("odd", [False, True])
def test_no_row_is_lost(spark, sf_small, odd):
    """Every role and derived date: the bounded role equals the whole role, filtered."""
    wh = Warehouse(spark, sf_small, reader=_lines_reader(spark, sf_small, odd))
    rng = random.Random(7)
    for role, column in ALL:
        first = dt.date(1996, 1, 1) + dt.timedelta(days=rng.randrange(1500))
        last = first + dt.timedelta(days=rng.choice([0, 6, 40, 400]))
        whole = getattr(wh, role)
        for lo, hi in ((first, last), (first, None), (None, last)):
            want = D.bounded(whole, column, None, lo, hi)
            got = wh.between(role, column, lo, hi)
            assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), (role, column, lo, hi)


def test_snapshots_are_chosen_among_all_files_of_their_month(spark, sf_small):
    wh = Warehouse(spark, sf_small)
    for first, last in ((dt.date(1995, 1, 1), dt.date(2000, 6, 15)), (dt.date(1997, 3, 10), dt.date(1998, 2, 8))):
        want = wh.selected_snapshots.where(F.col("file_date").between(first, last))
        got = wh.snapshots_between(first, last)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_seasons(spark, sf_small):
    assert season_dates("Fall 2000") == (dt.date(2000, 7, 1), dt.date(2000, 12, 31)) == season_dates("fall 2000")
    assert season_dates("Carryover") is None and season_dates("Spring 0000") is None
    wh = Warehouse(spark, sf_small)
    for season in ("Fall 2000", "Spring 1998", "Carryover"):
        assert wh.of_season(season).count() == wh.line_list.where(F.col("season") == season).count()


def test_shifts_hold_for_every_day():
    """earliest/latest against the dates themselves, over month ends, leap years and the ends of the calendar."""
    def add_months(d, n):
        m = d.year * 12 + d.month - 1 + n
        last = (dt.date(m // 12 + (m % 12 == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
        return dt.date(m // 12, m % 12 + 1, min(d.day, last))
    kinds = [(D.days_after("x", 5, 35), [lambda d, n=n: d + dt.timedelta(days=n) for n in (5, 20, 35)]),
             (D.months_after("x", 1, 7), [lambda d, n=n: add_months(d, n) for n in (1, 4, 7)]),
             (D.week_of("x"), [lambda d: d - dt.timedelta(days=d.weekday())]),
             (DERIVED["forecast"]["file_date"], [lambda d, n=n: d.replace(day=1) + dt.timedelta(days=n) for n in (-14, 0, 14)])]
    for i in range(0, 1200):
        day = dt.date(1999, 11, 1) + dt.timedelta(days=i)
        for rule, dates in kinds:
            for date in (f(day) for f in dates):
                assert rule.earliest(date) <= day <= rule.latest(date)
    for rule, _ in kinds:
        for d in (D.FIRST, D.LAST):
            assert D.FIRST <= rule.earliest(d) <= D.LAST and D.FIRST <= rule.latest(d) <= D.LAST


@pytest.fixture(scope="module")
def stored(spark, sf_small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("roles"))
    save_roles(Warehouse(spark, sf_small), path, roles=["sales_fact", "open_orders", "forecast", "sell_through", "calendar", "style_master", "sales_orders"])
    return StoredWarehouse(spark, path)


def test_stored_reach_is_measured_and_reaches_the_files(spark, sf_small, stored):
    assert stored._facts("sales_fact")["reach"]["request_ship_dt"] == [10, 70]
    first = FIXTURE.as_of.first_date_after_days_ago(FIXTURE.history_days)
    bound = stored._derived("sales_fact", "request_ship_dt").earliest(first)
    assert (first - bound).days == 70
    pushed = _pushed(REPORTS["sales_with_season"](stored, FIXTURE), "sales_fact/v-")
    assert any(f"GreaterThanOrEqual(transaction_dt,{bound})" in p for p in pushed), pushed
    pushed = _pushed(REPORTS["current_forecast"](stored, FIXTURE), "forecast/v-")
    assert any("GreaterThanOrEqual(file_date" in p for p in pushed), pushed
    pushed = _pushed(REPORTS["bulk_buckets"](stored, FIXTURE), "open_orders/v-")
    assert any("GreaterThanOrEqual(cancel_dt" in p and "LessThanOrEqual(cancel_dt" in p for p in pushed), pushed
    for name in ("sales_with_season", "current_forecast", "bulk_buckets"):
        want = present(REPORTS[name](Warehouse(spark, sf_small), FIXTURE))
        assert sorted(map(tuple, present(REPORTS[name](stored, FIXTURE)).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_reach_follows_the_data_and_is_left_out_where_a_source_is_missing(spark):
    df = spark.sql("SELECT DATE'2000-01-10' AS s, DATE'2000-01-05' AS a, DATE'2000-02-01' AS b, CAST(NULL AS DATE) AS c "
                   "UNION ALL SELECT NULL, NULL, DATE'2000-02-01', NULL UNION ALL SELECT DATE'2000-01-01', DATE'2000-03-01', NULL, NULL")
    assert D.measure(df, "s", ["a", "b", "c"]) == {"a": (-5, 60)}
    assert D.measure(df.limit(0), "s", ["a"]) == {} == D.measure(df, "s", [])
