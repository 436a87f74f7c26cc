"""Operator edge cases, each checked against a brute-force formulation of the original semantics."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tradewind.operators import accounts, forecast, joins, merge, product, sellthrough

D = dt.date


def rows(df, cols=None):
    cols = cols or sorted(df.columns)
    return Counter(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("inl", ["INL", "SMU", "UTY", None])
@pytest.mark.parametrize("intent", ["US", "US, Canada", "Canada", "", " ", None, "EMEA"])
def test_exclusivity_rules(spark, inl, intent):
    df = spark.createDataFrame([(inl, intent)], "inl_or_smu string, smu_intent string")
    r = df.select(product.exclusive_product_expr(F.col("inl_or_smu"), F.col("smu_intent")).alias("p"),
                  product.exclusive_account_expr(F.col("inl_or_smu"), F.col("smu_intent")).alias("a")).first()
    domestic = intent in ("US", "US, Canada", "Canada", "", None)
    want_p = ("No" if domestic else "Yes") if inl == "UTY" else ("No" if inl == "INL" else "Yes")
    want_a = "Yes" if inl == "SMU" else ("No" if domestic else "Yes")
    assert (r.p, r.a) == (want_p, want_a)


def test_anchored_merge_equals_full_outer_chain(spark):
    anchor = spark.createDataFrame([("1", 10), ("2", 20), (None, 30)], "b_m string, b_v int")
    s1 = spark.createDataFrame([("1", 1), ("1", 2), ("3", 3), (None, 4)], "s1_m string, s1_v int")
    s2 = spark.createDataFrame([("2", 5), ("3", 6), ("4", 7)], "s2_m string, s2_v int")
    got = merge.anchored_outer_merge(anchor, "b_m", [(s1, "s1_m"), (s2, "s2_m")])
    want = (anchor.join(s1, anchor.b_m == s1.s1_m, "full")
                  .join(s2, anchor.b_m == s2.s2_m, "full"))
    assert rows(got) == rows(want)


def test_outer_join_null_keys_never_match(spark):
    left = spark.createDataFrame([(1, "a", 1), (None, "a", 2), (2, None, 3), (2, "b", 4)], "k1 int, k2 string, lv int")
    right = spark.createDataFrame([(1, "a", 10), (None, "a", 20), (2, None, 30), (5, "z", 40)],
                                  "r1 int, r2 string, rv int")
    for how in ("left", "full"):
        got = joins.outer_join(left, right, ["k1", "k2"], ["r1", "r2"], how=how)
        want = left.join(right, (left.k1 == right.r1) & (left.k2 == right.r2), how)
        assert rows(got) == rows(want)


def test_number_rows_equals_row_number(spark):
    rnd = random.Random(7)
    data = [(rnd.choice("abc"), rnd.choice(["20201", "20202", "20211"]), rnd.randint(0, 5), i) for i in range(300)]
    df = spark.createDataFrame(data, "m string, hs string, t int, u int")
    got = product.number_rows(df, "m", "hs", ["t", "u"], out="n")
    w = Window.partitionBy("m").orderBy("hs", "t", "u")
    want = df.withColumn("n", F.row_number().over(w))
    assert rows(got) == rows(want)


def test_number_rows_keeps_null_keys(spark):
    data = [(m, h, t) for m in ("a", None) for h in ("1", None, "2") for t in (1, 2)]
    df = spark.createDataFrame(data, "m string, hs string, t int")
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("m").orderBy("hs", "t")))
    assert rows(product.number_rows(df, "m", "hs", ["t"], out="n")) == rows(want)


def test_sales_without_a_group_are_dropped(spark):
    sales = spark.createDataFrame(
        [("1A", "US", "11", g, D(2000, 6, 1)) for g in ("AUTO", None)],
        "order_type string, sales_org string, material string, forecast_group string, transaction_dt date")
    for c, t in (("transaction_year", "int"), ("transaction_month", "int"), ("region", "string"), ("material_description", "string"),
                 ("category", "string"), ("ship_qty", "bigint"), ("ship_amt", "double"), ("open_qty", "bigint"), ("open_amt", "double")):
        sales = sales.withColumn(c, F.lit(1).cast(t))
    sales = sales.withColumn("request_ship_dt", F.col("transaction_dt"))
    calendar = spark.createDataFrame([(D(2000, 6, 1), "S")], "the_date date, season_name string")
    out = accounts.sales_with_season(sales, calendar, "2000-06-15 10:00:00", rules=(), excluded_order_types=("x",), excluded_groups=())
    assert [r.forecast_group for r in out.collect()] == ["AUTO"]


def test_suppliers_of_any_size_have_their_own_upc(spark, tmp_path):
    from tradewind.sources import Warehouse
    lines = spark.createDataFrame([(1, 100000, 1), (2, 0, 2), (1, 5, 3), (15, 0, 4), (12345678901, 7, 5)], "l_partkey bigint, l_suppkey bigint, l_quantity bigint")
    lines = lines.withColumn("l_shipdate", F.lit(D(2000, 4, 1)))
    wh = Warehouse(spark, "none", reader=lambda s, name: lines)
    assert wh.upc_bridge.select("upc").distinct().count() == 5
    assert sorted(r.vendor_code for r in wh.forecast_sheet.collect()) == ["V0", "V0", "V100000", "V5", "V7"]


def test_sell_in_and_open_orders_from_one_read(spark, sf_small):
    from tradewind.operators import buckets
    from tradewind.plans import FIXTURE, REPORTS
    from tradewind.sources import Warehouse
    wh, p = Warehouse(spark, sf_small), FIXTURE
    both = buckets.sales_branches(wh.sales_fact, p.as_of, account_patterns=p.account_patterns, excluded_order_types=p.excluded_order_types,
                                  bulk_order_types=p.open_bulk_order_types, open_status=p.open_status, sales_org=p.sales_org, days=p.sell_in_days)
    sell_in, opened = REPORTS["sell_in_trailing"](wh, p).drop("t4w_sellin_rev"), REPORTS["open_order_buckets"](wh, p)
    assert rows(both.where("has_sell_in").select(*sell_in.columns)) == rows(sell_in)
    assert rows(both.where("has_open").select(*opened.columns)) == rows(opened)


def test_snapshot_dedup_collapses_equal_values(spark):
    base = dict(module="SalesForecast", forecast_group="AUTOMOBILE", calendar_season="Fall-Winter", material="7")
    recs = [(D(2000, 6, 1), D(2000, 8, 3), 5), (D(2000, 6, 15), D(2000, 8, 3), 5), (D(2000, 6, 20), D(2000, 8, 3), 7)]
    df = spark.createDataFrame([dict(base, file_date=f, demand_date=d, quantity=q) for f, d, q in recs])
    out = forecast.snapshot_dedup(df, account_patterns=["%AUTO%"])
    got = out.select("forecast", "snapshot_date").collect()
    assert sorted((r.forecast, r.snapshot_date) for r in got) == [(5, D(2000, 6, 15)), (7, D(2000, 6, 20))]
    pivot = forecast.forecast_month_pivot(out, "2000-06-15 10:00:00").first()
    assert (pivot.current_month_forecast, pivot.forecast_1m, pivot.forecast_2m) == (0, 0, 12)


def test_sell_through_multiplicity_matches_self_join(spark):
    recs = [("1", "d1", "MARKET A", D(2000, 6, 12), 3, 10), ("1", "d1", "MARKET B", D(2000, 6, 12), 4, 11),
            ("1", "d1", "MARKET A", D(2000, 6, 5), 5, 12), ("2", "d2", "MARKET A", D(2000, 6, 5), 6, 13),
            ("3", "d3", "MARKET A", D(2000, 6, 12), 1, 14), ("3", "d3x", "MARKET A", D(2000, 6, 12), 2, 14)]
    df = spark.createDataFrame(recs, "material string, material_description string, retailer string, "
                                     "week_start date, units_sold bigint, units_on_hand bigint")
    got = sellthrough.sell_through(df, "2000-06-15 10:00:00", retailer_patterns=["%MARKET%"])
    w = sellthrough.sell_through_window(df, "2000-06-15 10:00:00", retailer_patterns=["%MARKET%"])
    tot = w.groupBy("material", "material_description").agg(F.sum("units_sold").alias("t"))
    mx = w.agg(F.max("week_start")).first()[0]
    o = w.where(F.col("week_start") == mx).select(F.col("material").alias("om"), F.col("week_start").alias("ow"),
                                                  F.col("units_on_hand").alias("oh"))
    pairs = (w.join(o, (w.material == o.om) & (w.week_start == o.ow))
              .join(tot.select(F.col("material").alias("tm"), "t"), F.col("material") == F.col("tm"))
              .select("material", "material_description", F.col("t").alias("t4w_sellthru_units"),
                      F.col("oh").alias("retailer_onhand")))
    want = pairs.groupBy(*pairs.columns).agg(F.count(F.lit(1)).alias("copies"))
    assert rows(got) == rows(want)
    # material 1: 2 rows x 2 on-hand rows x 1 total; material 3: 2 x 2 x 2 totals (two descriptions)
    assert sum(r.copies for r in got.collect()) == 4 + 8


def test_net_revenue_price_fallback(spark):
    ps = spark.createDataFrame(
        [(15, "AUTO", "New", "No", "01", "Fall-Winter", 2000, 1, 1, 1, 1.0, 1.0, None, None),
         (16, "AUTO", "New", "No", "01", "Fall-Winter", 2000, 1, 1, 1, 1.0, 1.0, 9.5, None)],
        "material int, forecast_group string, classification string, exclusive string, month string, "
        "calendar_season string, year int, forecasted_quantity bigint, sold_quantity bigint, open_quantity bigint, "
        "actual_revenue double, open_revenue double, msrp double, whsl double")
    for c in accounts.pivot_columns():
        ps = ps.withColumn(c, F.lit(0))
    ps = (ps.withColumn("projected_sales", F.lit(1).cast("bigint"))
            .withColumn("msrp", F.col("msrp").cast("decimal(18,2)"))
            .withColumn("whsl", F.col("whsl").cast("decimal(18,2)")))
    style = spark.createDataFrame([("15", "x", "c", "D1", "D1", "Mens", 3.25), ("16", "y", "c", "D1", "D1", "Mens", 4.0)],
                                  "material string, material_description string, category string, division string, "
                                  "playbook_division string, gender string, price double")
    style = style.withColumn("price", F.col("price").cast("decimal(18,2)"))
    out = {r.material: (float(r.msrp), float(r.whsl)) for r in accounts.net_revenue_by_account(ps, style).collect()}
    assert out == {15: (6.5, 3.25), 16: (9.5, 4.0)}


def test_snapshot_dedup_null_and_negative(spark):
    base = dict(module="SalesForecast", forecast_group="AUTOMOBILE", calendar_season="Fall-Winter", material="8")
    recs = [(D(2000, 6, 1), D(2000, 6, 20), None), (D(2000, 6, 1), D(2000, 7, 3), -4),
            (D(2000, 6, 15), D(2000, 7, 9), -2)]
    df = spark.createDataFrame([dict(base, file_date=f, demand_date=d, quantity=q) for f, d, q in recs],
                               "module string, forecast_group string, calendar_season string, material string, "
                               "file_date date, demand_date date, quantity bigint")
    out = forecast.snapshot_dedup(df, account_patterns=["%AUTO%"])
    assert sorted((r.forecasted_date, r.forecast) for r in out.collect()) == [
        (D(2000, 6, 1), None), (D(2000, 7, 1), -4), (D(2000, 7, 1), -2)]
    pivot = forecast.forecast_month_pivot(out, "2000-06-15 10:00:00").first()
    # current month: MAX over {NULL (June sum), 0 (July row)} = 0; next month: MAX{0, -6} floors at 0
    assert (pivot.current_month_forecast, pivot.forecast_1m, pivot.forecast_2m) == (0, 0, 0)


def _fact_frame(spark, recs):
    cols = ["forecast_group", "material", "material_description", "year", "calendar_season", "month",
            "forecasted_quantity", "sold_quantity", "open_quantity", "actual_revenue", "open_revenue",
            *accounts.pivot_columns(), "msrp", "whsl"]
    rows = [(g, m, d, y, s, mo, fq, sq, 0, 0.0, 0.0, *([0] * len(accounts.pivot_columns())), None, None)
            for g, m, d, y, s, mo, fq, sq in recs]
    schema = ", ".join(f"{c} {t}" for c, t in zip(cols, ["string", "int", "string", "int", "string", "string",
                                                        "bigint", "bigint", "bigint", "double", "double",
                                                        *["bigint"] * len(accounts.pivot_columns()),
                                                        "double", "double"]))
    return spark.createDataFrame(rows, schema)


def test_account_final_equals_join_then_distinct(spark):
    rnd = random.Random(11)
    recs = [(rnd.choice(["A", "B"]), rnd.choice([11, 12]), rnd.choice(["x", "y"]), 2000,
             rnd.choice(["Fall-Winter", "Spring-Summer"]), rnd.choice(["01", "02"]), rnd.randint(0, 2),
             rnd.randint(0, 2)) for _ in range(80)]
    priced = _fact_frame(spark, recs)
    cls = spark.createDataFrame(
        [(rnd.choice([11, 12, 13]), rnd.choice(["Fall-Winter", "Spring-Summer"]), rnd.choice([2000, 2001]),
          rnd.choice([1, 2, None]), rnd.choice(["New", "Inline"]), rnd.choice(["Yes", "No"])) for _ in range(40)],
        "material int, calendar_season string, year int, season_number int, classification string, "
        "exclusive string")
    got = accounts.account_final(priced, cls)
    keys = ["material", "calendar_season", "year"]
    want = priced.join(cls, keys).select(*got.columns).distinct()
    assert rows(got) == rows(want)


def test_projected_sales_multiplies_rows_differing_only_in_description(spark):
    recs = [("A", 11, "x", 2000, "Fall-Winter", "01", 5, 3), ("A", 11, "y", 2000, "Fall-Winter", "01", 5, 3),
            ("A", 11, "x", 2000, "Fall-Winter", "09", 5, 3)]
    final = (_fact_frame(spark, recs).withColumn("season_number", F.lit(1))
             .withColumn("classification", F.lit("New")).withColumn("exclusive", F.lit("No")))
    got = {r.month: r.projected_sales for r in accounts.projected_sales(final, "2000-06-15 10:00:00").collect()}
    # January is past: sold 3 summed over the two rows -> 6; September is current/future: forecast 5
    assert got == {"01": 6, "09": 5}


def test_outer_join_requires_equal_key_types(spark):
    left = spark.createDataFrame([(1, "a")], "k int, lv string")
    right = spark.createDataFrame([(1, "b")], "rk bigint, rv string")
    with pytest.raises(TypeError):
        joins.outer_join(left, right, ["k"], ["rk"], how="left")
    ok = joins.outer_join(left, right.select(F.col("rk").cast("int").alias("rk"), "rv"), ["k"], ["rk"], how="left")
    assert [tuple(r) for r in ok.collect()] == [(1, "a", 1, "b")]
