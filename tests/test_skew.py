"""Hot groups are split across tasks (one key holding a third of all rows)."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tradewind.operators import joins, merge, product


@pytest.fixture()
def no_coalesce(spark):
    # keep the planned partitions so the spread of rows over tasks is observable
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def _partitions_of(df, cond):
    # hash every column so no operator above the shuffle is pruned away before the partition id is read
    probe = df.where(cond).select(F.spark_partition_id().alias("p"), F.hash(*df.columns).alias("h"))
    return probe.groupBy("p").agg(F.sum("h")).count()


def test_row_numbering_splits_a_hot_material(no_coalesce):
    spark = no_coalesce
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 997).cast("string")).alias("m"),
        F.format_string("20%02d", (F.col("id") / 3).cast("long") % 12).alias("hs"),
        F.col("id").alias("t"))
    got = product.number_rows(df, "m", "hs", ["t"], out="n")
    naive = df.withColumn("n", F.row_number().over(Window.partitionBy("m").orderBy("hs", "t")))
    # the hot material's rows are numbered in several tasks (one per group of its seasons)
    assert _partitions_of(got, F.col("m") == "hot") >= 4
    # and the numbering is still the per-material row number
    assert got.where(F.col("m") == "hot").agg(F.min("n"), F.max("n"), F.count_distinct("n")).first() == (1, n // 3, n // 3)
    assert got.join(naive, ["m", "hs", "t", "n"], "left_anti").count() == 0


def test_outer_join_spreads_null_keys(no_coalesce):
    spark = no_coalesce
    left = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("lv"))
    right = spark.range(500).select(F.col("id").alias("rk"), (F.col("id") * 2).alias("rv"))
    got = joins.outer_join(left, right, ["k"], ["rk"], how="full")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        naive = left.join(right, left.k == right.rk, "full")
        assert _partitions_of(naive, F.col("k").isNull()) == 1
        assert _partitions_of(got, F.col("k").isNull()) >= 8
        assert got.count() == naive.count() == 30000
        assert got.where(F.col("k").isNull() & F.col("rk").isNotNull()).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture()
def divided(no_coalesce):
    """Sort-merge joins whose hot partitions adaptive execution divides, at the sizes of a test."""
    spark = no_coalesce
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield spark
    for key in conf:
        spark.conf.unset(key)


def _source(spark, name, hot, n=30000):
    """A third of the rows on one key."""
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("id") % 400).alias(f"{name}_k"),
                                 F.sha2(F.col("id").cast("string"), 256).alias(f"{name}_v")).repartition(8)


def _naive_merge(anchor, sources):
    out = anchor
    for df, key in sources:
        out = out.join(df, df[key] == anchor["a_k"], "full")
    return out


@pytest.mark.parametrize("hot", [999999, None])
def test_a_hot_key_that_the_anchor_lacks_spreads(divided, hot):
    """An unmatched key (or NULL) on a third of a source's rows is in many tasks and in no list."""
    spark = divided
    anchor = spark.range(300).select(F.col("id").alias("a_k"), (F.col("id") * 2).alias("a_v"))
    sources = [(_source(spark, "s", hot), "s_k"), (spark.range(350).select(F.col("id").alias("t_k"), F.col("id").alias("t_v")), "t_k")]
    got = merge.anchored_outer_merge(anchor, "a_k", sources)
    own = F.col("s_k").isNull() & F.col("s_v").isNotNull() if hot is None else F.col("s_k") == hot
    assert _partitions_of(got, own) >= 8
    sizes = [r["n"] for r in got.where(own).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max(F.hash("s_v"))).collect()]
    assert sum(sizes) == 10000 and max(sizes) < 3000
    want = _naive_merge(anchor, sources)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_equal_rows_of_a_lonely_key_are_all_kept(no_coalesce):
    spark = no_coalesce
    anchor = spark.range(2).select(F.col("id").alias("a_k"))
    source = spark.range(900).select((F.col("id") % 3 + 1).alias("s_k"), F.lit("x").alias("s_v"))
    got = merge.anchored_outer_merge(anchor, "a_k", [(source, "s_k")])
    want = _naive_merge(anchor, [(source, "s_k")])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_divided_full_join_spreads_a_hot_key_of_either_side(divided):
    spark = divided
    left = spark.range(400).select(F.col("id").alias("k"), F.col("id").alias("lv"))
    for hot, l, r, lk, rk in ((999999, left, _source(spark, "s", 999999), "k", "s_k"), (7, _source(spark, "s", 7), left, "s_k", "k")):
        got = joins.outer_join(l, r, [lk], [rk], how="full", divide=True)
        want = l.join(r, l[lk] == r[rk], "full")
        assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).isEmpty()
        # the key is told apart after the join, so that the other rows take part in it
        probe = got.select(F.spark_partition_id().alias("p"), (F.col("s_k") == hot).alias("hot"), F.hash(*got.columns).alias("h"))
        rows = probe.groupBy("p", "hot").agg(F.sum("h"), F.count("*").alias("n")).collect()
        sizes = [x["n"] for x in rows if x["hot"]]
        assert len(sizes) >= 4 and sum(sizes) >= 10000


def test_null_groups_follow_the_partitions(no_coalesce):
    df = no_coalesce.range(1)
    assert joins.null_groups(df) == 4 * 16
