"""Stored role tables give the same reports as role views over the raw tables, and prune by date."""

import re
import tempfile

import pytest

from tradewind.plans import FIXTURE, REPORTS, present
from tradewind.sources import StoredWarehouse, Warehouse, jdbc_reader, save_roles
from tradewind.sources.derived import small_side


@pytest.fixture(scope="module")
def stored(spark, sf_small):
    path = tempfile.mkdtemp(prefix="tradewind-roles-")
    save_roles(Warehouse(spark, sf_small), path)
    return StoredWarehouse(spark, path)


@pytest.mark.parametrize("name", ["forecast_vs_actual", "marketing_dashboard", "net_revenue_by_account",
                                  "product_classification", "sheet_rollup"])
def test_stored_roles_give_same_reports(spark, sf_small, stored, name):
    raw = present(REPORTS[name](Warehouse(spark, sf_small), FIXTURE))
    got = present(REPORTS[name](stored, FIXTURE))
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in raw.schema]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, raw.collect()), key=repr)


def _scan_line(df, role):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if role in line][0]


def test_trailing_window_filter_reaches_stored_files(stored):
    df = REPORTS["sell_in_trailing"](stored, FIXTURE)
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    block = text[text.index("sales_fact"):]
    pushed = re.search(r"PushedFilters: (\[.*\])", block).group(1)
    assert "GreaterThanOrEqual(transaction_dt" in pushed


def test_date_directories_prune_partitions(spark, sf_small):
    path = tempfile.mkdtemp(prefix="tradewind-roles-dated-")
    save_roles(Warehouse(spark, sf_small), path, roles=["sales_fact"], partition_by_date=True)
    dated = StoredWarehouse(spark, path)
    df = REPORTS["sell_in_trailing"](dated, FIXTURE)
    assert re.search(r"PartitionFilters: \[[^\]]*transaction_dt", _scan_line(df, "sales_fact"))
    raw = REPORTS["sell_in_trailing"](Warehouse(spark, sf_small), FIXTURE)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, raw.collect()), key=repr)


def test_a_failed_save_leaves_the_old_copy(spark, sf_small, tmp_path):
    save_roles(Warehouse(spark, sf_small), str(tmp_path), roles=["style_master"])
    before = StoredWarehouse(spark, str(tmp_path)).style_master.count()

    class Broken:
        def __init__(self):
            self.spark = spark
            self.style_master = spark.range(5).selectExpr("raise_error('lost') AS material")
    with pytest.raises(Exception, match="lost"):
        save_roles(Broken(), str(tmp_path), roles=["style_master"])
    assert StoredWarehouse(spark, str(tmp_path)).style_master.count() == before
    save_roles(Warehouse(spark, sf_small), str(tmp_path), roles=["style_master"])
    assert StoredWarehouse(spark, str(tmp_path)).style_master.count() == before


def test_a_run_lost_between_write_and_switch_leaves_the_old_copy(spark, sf_small, tmp_path, monkeypatch):
    from tradewind.sources import store
    save_roles(Warehouse(spark, sf_small), str(tmp_path), roles=["style_master"])
    reader = StoredWarehouse(spark, str(tmp_path))
    before = sorted(map(tuple, reader.style_master.collect()))

    def lost(*_, **__):
        raise KeyboardInterrupt
    monkeypatch.setattr(store, "switch", lost)
    with pytest.raises(KeyboardInterrupt):
        save_roles(_Other(spark), str(tmp_path), roles=["style_master"])
    assert len(list((tmp_path / "style_master").glob("v-*"))) == 2  # the new one is whole, but not current
    assert sorted(map(tuple, StoredWarehouse(spark, str(tmp_path)).style_master.collect())) == before
    monkeypatch.undo()
    save_roles(_Other(spark), str(tmp_path), roles=["style_master"])
    assert StoredWarehouse(spark, str(tmp_path)).style_master.count() == 5
    assert sorted(map(tuple, reader.style_master.collect())) == before  # a reader that has begun goes on
    assert len(list((tmp_path / "style_master").glob("v-*"))) == 2  # the current one and the one before


class _Other:
    def __init__(self, spark):
        self.spark = spark
        self.style_master = spark.range(5).selectExpr("cast(id AS string) AS material")


def test_missing_role_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="calendar"):
        StoredWarehouse(spark, str(tmp_path)).calendar


# -- buckets ---------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def bucketed(spark, sf_small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("buckets"))
    save_roles(Warehouse(spark, sf_small), path, partition_by_date=["forecast"], buckets=6)
    return StoredWarehouse(spark, path)


@pytest.fixture()
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for key in keys:
        spark.conf.unset(key)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["inbound_buckets", "sell_in_trailing", "open_order_buckets", "season_span", "season_prices"])
def test_groupings_by_material_need_no_exchange(no_broadcast, bucketed, name):
    plan = _plan(REPORTS[name](bucketed, FIXTURE))
    assert "Exchange" not in plan and "HashAggregate" in plan


def test_join_by_order_needs_no_exchange(no_broadcast, bucketed):
    """Only the grouping by material after the join moves rows."""
    plan = _plan(REPORTS["bulk_buckets"](bucketed, FIXTURE))
    assert "LeftSemi" in plan and plan.count("Exchange") == 1 and "hashpartitioning(order_id" not in plan
    above, below = plan.split("Exchange")
    assert "LeftSemi" in below and "LeftSemi" not in above


@pytest.mark.parametrize("name", ["forecast_vs_actual", "marketing_dashboard", "net_revenue_by_account", "product_classification",
                                  "bulk_buckets", "order_type_pivot", "sheet_rollup"])
def test_bucketed_roles_give_same_reports(spark, sf_small, bucketed, name):
    raw = present(REPORTS[name](Warehouse(spark, sf_small), FIXTURE))
    got = present(REPORTS[name](bucketed, FIXTURE))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, raw.collect()), key=repr)


def test_buckets_skip_by_date_and_hold_one_file_each(spark, bucketed):
    told = bucketed._facts("sales_fact")
    assert told["buckets"] == ["material", 6]
    files = {f.rsplit("/", 1)[1] for f in spark.read.parquet(told["version"]).inputFiles()}
    assert len(files) == 6
    df = REPORTS["sell_in_trailing"](bucketed, FIXTURE)
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(transaction_dt" in text and "SelectedBucketsCount: 6 out of 6" in text
    assert not spark.catalog.tableExists("tradewind_none")


def test_a_hot_key_is_not_put_into_one_bucket(spark, tmp_path):
    class Hot:
        def __init__(self):
            self.spark = spark
            self.sales_orders = spark.range(20000).selectExpr("if(id % 3 = 0, 7, id) AS order_id", "'a' AS forecast_group", "'US' AS sales_org", "'x' AS order_type")
    save_roles(Hot(), str(tmp_path), roles=["sales_orders"], buckets=16)
    wh = StoredWarehouse(spark, str(tmp_path))
    assert wh._facts("sales_orders")["buckets"] is None and wh.sales_orders.count() == 20000


# -- forecast files pruned by the selected snapshots -----------------------------------------------

#: a shuffle of a fact for its join with the snapshots (the partial sums are shuffled on other keys)
SNAPSHOT_JOIN = re.compile(r"Exchange hashpartitioning\(file_date#\d+, module#\d+, (sales|forecast)_group")


def _directory_filters(df):
    """The scan of the forecast files is pruned by what the snapshots hold."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    block = next(b for b in text.split("\n\n") if "Scan parquet" in b and "/forecast/" in b)
    return "dynamicpruning" in re.search(r"PartitionFilters: (\[.*\])", block).group(1)


def test_snapshots_prune_the_file_directories(spark, sf_small, bucketed):
    df = REPORTS["lead_forecast"](bucketed, FIXTURE)
    plan = _plan(df)
    assert not SNAPSHOT_JOIN.search(plan)
    assert _directory_filters(df)
    df.collect()
    want = present(REPORTS["lead_forecast"](Warehouse(spark, sf_small), FIXTURE))
    assert sorted(map(tuple, present(df).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_fewer_snapshots_read_fewer_directories(spark, bucketed):
    """A report over two months opens the files of the snapshots of these months alone."""
    import dataclasses
    import datetime as dt
    p = dataclasses.replace(FIXTURE, lead_date_from=dt.date(2000, 5, 1))
    assert _directory_filters(REPORTS["lead_forecast"](bucketed, p))


def test_facts_are_not_shuffled_on_file_dates(spark, sf_small):
    assert not SNAPSHOT_JOIN.search(_plan(REPORTS["lead_forecast"](Warehouse(spark, sf_small), FIXTURE)))


def test_a_side_is_held_by_value_only_below_its_bound(spark):
    df = spark.range(50)
    assert small_side(df, 49) is df
    held = small_side(df, 50)
    assert held is not df and sorted(r[0] for r in held.collect()) == list(range(50))


def test_jdbc_reader_refuses_an_unpartitioned_fact(spark):
    read = jdbc_reader("jdbc:none:", {}, {"orders": ("o_orderkey", 0, 10, 2)})
    with pytest.raises(ValueError, match="one task"):
        read(spark, "lineitem")


def test_warehouse_uses_given_table_reader(spark, sf_small):
    seen = []

    def reader(s, name):
        seen.append(name)
        return s.read.parquet(f"{sf_small}/{name}.parquet")

    wh = Warehouse(spark, "unused-location", reader=reader)
    got = REPORTS["inbound_buckets"](wh, FIXTURE).count()
    assert got == REPORTS["inbound_buckets"](Warehouse(spark, sf_small), FIXTURE).count()
    assert sorted(seen) == ["lineitem", "part"]
