"""Edge tables for the scalar helpers (FIXTURES.md §4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradewind.functions import (AsOf, after_days_ago, apply_rules, between_now_and, concat_skip_null,
                                 historic_season, month_diff, month_floor, month_window, months_from,
                                 on_or_before_now, safe_int, season_half_fall_first, season_half_spring_first,
                                 season_year, two_digit)

D = dt.date


def test_month_diff_counts_boundaries(spark):
    rows = [(D(2022, 1, 31), D(2022, 2, 1)), (D(2021, 12, 31), D(2022, 1, 1)), (D(2022, 2, 1), D(2022, 1, 31)),
            (D(2022, 3, 1), D(2022, 3, 31)), (None, D(2022, 3, 1))]
    df = spark.createDataFrame(rows, "a date, b date")
    got = [r[0] for r in df.select(month_diff(F.col("a"), F.col("b"))).collect()]
    assert got == [1, 1, -1, 0, None]


def test_months_from_and_window(spark):
    as_of = AsOf.of("2000-06-15 10:00:00")
    rows = [(D(2000, 5, 31),), (D(2000, 6, 1),), (D(2000, 7, 31),), (D(2000, 8, 1),)]
    df = spark.createDataFrame(rows, "d date")
    got = df.select(months_from(as_of, F.col("d")), month_window(as_of, 0, 1, F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(-1, False), (0, True), (1, True), (2, False)]


def test_month_floor_keeps_date(spark):
    df = spark.createDataFrame([(dt.datetime(2000, 6, 15, 10, 30),)], "t timestamp_ntz")
    r = df.select(month_floor(F.col("t")).alias("m")).collect()[0]
    assert r.m == D(2000, 6, 1)


@pytest.mark.parametrize("clock,expected", [
    ("2000-06-15 10:00:00", [False, False, True, True, True, False]),
    ("2000-06-15 00:00:00", [False, True, True, True, True, False]),
])
def test_between_now_and_honours_time_of_day(spark, clock, expected):
    as_of = AsOf.of(clock)
    days = [D(2000, 6, 14), D(2000, 6, 15), D(2000, 6, 16), D(2000, 6, 20), D(2000, 6, 22), D(2000, 6, 23)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r[0] for r in df.select(between_now_and(as_of, 7, F.col("d"))).collect()]
    assert got == expected


@pytest.mark.parametrize("clock", ["2000-06-15 10:00:00", "2000-06-15 00:00:00"])
def test_trailing_days_keep_29_dates_and_later(spark, clock):
    as_of = AsOf.of(clock)
    base = D(2000, 6, 15)
    offsets = [-29, -28, 0, 7, 8]
    df = spark.createDataFrame([(base + dt.timedelta(days=o),) for o in offsets], "d date")
    got = [r[0] for r in df.select(after_days_ago(as_of, 29, F.col("d"))).collect()]
    assert got == [False, True, True, True, True]
    le = [r[0] for r in df.select(on_or_before_now(as_of, F.col("d"))).collect()]
    assert le == [True, True, True, False, False]


def test_text_helpers(spark):
    df = spark.createDataFrame([("123", 3, "a"), ("Other", None, None), ("", 12, "b"), (None, 7, None),
                                ("000123", 1, "c")], "m string, n int, s string")
    got = df.select(safe_int("m"), two_digit("n"), concat_skip_null("m", "s")).collect()
    assert [tuple(r) for r in got] == [(123, "03", "123a"), (None, None, "Other"), (None, "12", "b"),
                                       (None, "07", ""), (123, "01", "000123c")]


def test_whole_numbers_beyond_a_bigint_are_an_error(spark):
    df = spark.createDataFrame([("12345678901",), ("4.0",), (" 7 ",), ("x1",)], "m string")
    assert [r[0] for r in df.select(safe_int("m")).collect()] == [12345678901, None, 7, None]
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([("99999999999999999999",)], "m string").select(safe_int("m")).collect()


def test_season_helpers(spark):
    df = spark.createDataFrame([("Spring 2021",), ("FALL 2021",), ("Carryover",), (None,)], "season string")
    got = df.select(season_year("season"), season_half_spring_first("season"), season_half_fall_first("season"),
                    historic_season("season")).collect()
    assert [tuple(r) for r in got] == [
        (2021, "Spring-Summer", "Spring-Summer", "20211"),
        (2021, "Fall-Winter", "Fall-Winter", "20212"),
        (None, "Fall-Winter", "Spring-Summer", "over2"),
        (None, "Fall-Winter", "Spring-Summer", "2"),
    ]


def test_rules_first_match_wins(spark):
    rules = (("equals", ("BUILDING", "FURNITURE"), "HOME"), ("contains", ("auto",), "AUTO"),
             ("contains", ("BUILD",), "never"))
    df = spark.createDataFrame([("BUILDING",), ("AUTOMOBILE",), ("HOUSEHOLD",), (None,)], "g string")
    got = [r[0] for r in df.select(apply_rules("g", rules)).collect()]
    assert got == ["HOME", "AUTO", "HOUSEHOLD", None]


def test_rules_with_apostrophe_match_in_spark_and_sql(spark):
    import duckdb

    from tradewind.oracle.queries_sql import group_name
    rules = (("equals", ("SPORTSMAN'S_WAREHOUSE",), "SPORTSMAN'S WAREHOUSE"), ("contains", ("O'NEIL",), "ONEIL"))
    values = ["SPORTSMAN'S_WAREHOUSE", "shop o'neil east", "OTHER"]
    df = spark.createDataFrame([(v,) for v in values], "g string")
    got = [r[0] for r in df.select(apply_rules("g", rules)).collect()]
    con = duckdb.connect()
    sql = f"SELECT {group_name('g', rules)} FROM (VALUES " + ", ".join(
        "('" + v.replace("'", "''") + "')" for v in values) + ") t(g)"
    want = [r[0] for r in con.execute(sql).fetchall()]
    assert got == want == ["SPORTSMAN'S WAREHOUSE", "ONEIL", "OTHER"]
