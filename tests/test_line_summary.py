"""Spans, numbers and prices from the one-pass summary equal those computed from the line list itself."""

import random

import pytest
from pyspark.sql import functions as F

from tradewind.operators import accounts, product

SCHEMA = "material string, season string, inl_or_smu string, smu_intent string, model string, gender string, msrp decimal(18,2), whsl decimal(18,2)"


def rows(seed, n):
    from decimal import Decimal
    rng = random.Random(seed)
    seasons = ["Spring 2019", "Fall 2019", "Spring 2020", "FALL 2021", "Carryover", "spring 2020 ", None]
    money = lambda: rng.choice([None, Decimal("10.00"), Decimal("25.50"), Decimal("99.99")])
    out = {(rng.choice(["11", "12", "1x", "100", "21", None]), rng.choice(seasons), rng.choice(["INL", "SMU", None]), rng.choice(["US", "", None]),
            rng.choice(["a", "b", None]), rng.choice(["Mens", "Womens", None]), money(), money()) for _ in range(n)}
    return list(out)


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_the_separate_passes(spark, seed):
    ll = spark.createDataFrame(rows(seed, 250), SCHEMA)
    summary = product.line_summary(ll, "1")
    assert bag(product.span_of(summary)) == bag(product.season_span(ll, "1"))
    got, want = product.numbers_of(summary), product.season_number(ll, material_prefix="1")
    assert got.columns == want.columns and bag(got) == bag(want)
    assert bag(product.numbers_of(summary, detail=())) == bag(product.season_number(ll, detail=(), material_prefix="1"))
    got, want = product.prices_of(product.line_summary(ll)), accounts.season_prices(ll)
    assert got.columns == want.columns and bag(got) == bag(want)


def test_empty_line_list(spark):
    summary = product.line_summary(spark.createDataFrame([], SCHEMA), "1")
    assert product.span_of(summary).count() == product.numbers_of(summary).count() == product.prices_of(summary).count() == 0


def test_a_material_with_many_lines_is_not_numbered_by_one_task(spark):
    """A third of all lines are one material's; its lines are dealt by season."""
    keys = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold",
            "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key, value in zip(keys, ("false", "16", "-1", "-1")):
        spark.conf.set(key, value)
    try:
        ll = spark.range(24000).selectExpr(
            "if(id % 3 = 0, '1hot', concat('1', id % 997)) AS material", "concat('Fall ', 2000 + cast(id / 3 AS int) % 24) AS season", "'INL' AS inl_or_smu",
            "cast(id AS string) AS smu_intent", "'m' AS model", "'g' AS gender", "cast(1 AS decimal(18,2)) AS msrp", "cast(1 AS decimal(18,2)) AS whsl")
        numbered = product.numbers_of(product.line_summary(ll, "1")).where("material = '1hot'")
        probe = numbered.select(F.spark_partition_id().alias("p"), F.hash(*numbered.columns).alias("h"), "season_number")
        tasks = probe.groupBy("p").agg(F.sum("h"), F.count("*").alias("n")).collect()
        assert len(tasks) >= 6 and sum(t["n"] for t in tasks) == 8000
        assert numbered.agg(F.min("season_number"), F.max("season_number"), F.count_distinct("season_number")).first() == (1, 8000, 8000)
    finally:
        for key, value in zip(keys, ("true", "8", None, None)):
            spark.conf.set(key, value) if value else spark.conf.unset(key)
