"""Session helpers: the shared folder, stored tables and cluster sizing."""

import pytest
from pyspark.sql import functions as F

from tradewind.session import TableStore, cluster_conf, shared_dir


def test_shared_dir_is_the_named_folder(spark):
    assert shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def test_tables_are_kept_below_the_folder_and_deleted(spark, tmp_path):
    with TableStore(spark, f"file://{tmp_path}") as tables:
        dfs = [spark.range(n).withColumn("n", F.lit(n)) for n in (3, 5, 7)]
        out = tables.keep_all(dfs)
        assert [d.count() for d in out] == [3, 5, 7] and [d.first()["n"] for d in out] == [3, 5, 7]
        assert all(str(tmp_path) in f for d in out for f in d.inputFiles())
        assert tables.keep(spark.range(0)).count() == 0
    assert not any(tmp_path.iterdir())


def test_a_failing_table_fails_the_caller(spark, tmp_path):
    bad = spark.range(3).select(F.raise_error(F.lit("no such row")).alias("x"))
    with TableStore(spark, f"file://{tmp_path}") as tables, pytest.raises(Exception, match="no such row"):
        tables.keep_all([spark.range(2), bad])


def test_cluster_refuses_a_machine_local_folder(spark):
    class Elsewhere:
        class sparkContext:
            master = "yarn"
    with pytest.raises(ValueError):
        TableStore(Elsewhere, "/tmp/x")
    with pytest.raises(ValueError):
        TableStore(Elsewhere, "file:///tmp/x")
    TableStore(Elsewhere, "hdfs://x/y")
    TableStore(Elsewhere, "file:///mnt/shared", mounted=True)


def test_cluster_conf_sizes_partitions_from_input():
    big = cluster_conf(100 * 2**40, executors=1000, cores_per_executor=8)
    assert int(big["spark.sql.shuffle.partitions"]) == 102400
    small = cluster_conf(2**30, executors=10, cores_per_executor=4)
    assert int(small["spark.sql.shuffle.partitions"]) == 80  # at least two tasks per core
    assert big["spark.sql.adaptive.enabled"] == "true" and big["spark.sql.adaptive.skewJoin.enabled"] == "true"
