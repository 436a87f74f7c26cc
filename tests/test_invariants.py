"""Invariants on the fixture reports and determinism across shuffle-partition counts."""

from pyspark.sql import functions as F

from tradewind.plans import FIXTURE, REPORTS
from tradewind.sources import Warehouse


def test_inbound_buckets_are_cumulative(spark, sf_small):
    df = REPORTS["inbound_buckets"](Warehouse(spark, sf_small), FIXTURE)
    cols = [f"inbound_{w}w" for w in FIXTURE.inbound_weeks]
    bad = df.where(F.greatest(*[F.col(a) > F.col(b) for a, b in zip(cols, cols[1:])]))
    assert bad.count() == 0


def test_bulk_parts_within_total(spark, sf_small):
    df = REPORTS["bulk_buckets"](Warehouse(spark, sf_small), FIXTURE)
    bad = df.where((F.col("current_month_bulk") + F.col("current_month_bulk_landing_next_month")
                    > F.col("current_month_total_bulk"))
                   | (F.col("next_month_bulk") + F.col("next_month_bulk_landing_month_after")
                      > F.col("next_month_total_bulk")))
    assert bad.count() == 0


def test_order_type_pivot_within_totals(spark, sf_small):
    df = REPORTS["order_type_pivot"](Warehouse(spark, sf_small), FIXTURE)
    sold = F.col("closeout_sold_quantity") + F.col("preseason_sold_quantity") + F.col("atonce_sold_quantity")
    opened = F.col("closeout_open_quantity") + F.col("preseason_open_quantity") + F.col("atonce_open_quantity")
    assert df.where((sold > F.col("units")) | (opened > F.col("open_units"))).count() == 0


def test_classification_is_total(spark, sf_small):
    wh = Warehouse(spark, sf_small)
    for name in ("lifecycle_class", "lifecycle_class_account"):
        df = REPORTS[name](wh, FIXTURE)
        assert df.where(F.col("classification").isNull()).count() == 0


def test_same_result_for_1_and_8_partitions(spark, sf_small):
    wh = Warehouse(spark, sf_small)
    results = []
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = []
        for name in ("marketing_dashboard", "season_number", "net_revenue_by_account"):
            got.append(sorted(map(tuple, REPORTS[name](wh, FIXTURE).collect()), key=repr))
        results.append(got)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
