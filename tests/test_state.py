"""Forecast states grow file by file and equal a run over all files."""

import datetime as dt
import re
from functools import partial

import pytest
from pyspark.sql import functions as F

from tradewind.operators import forecast
from tradewind.plans import FIXTURE, REPORTS, present
from tradewind.sources import StoredWarehouse, Warehouse, advance, files_of, read_state, save_roles

DEDUP = partial(forecast.snapshot_dedup, account_patterns=FIXTURE.account_patterns, module=FIXTURE.forecast_module)
CURRENT = partial(forecast.current_state, rules=FIXTURE.forecast_rules, sales_org=FIXTURE.sales_org, module=FIXTURE.forecast_module,
                  material_prefix=FIXTURE.material_prefix)


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def stored(spark, sf_small, tmp_path_factory):
    """Forecast files of six months, the last of which arrives later."""
    path = str(tmp_path_factory.mktemp("roles"))

    class Some(Warehouse):
        @property
        def forecast(self):
            own = Warehouse.forecast.fget(self)
            return own.where(F.col("file_date").between(F.lit(dt.date(2000, 1, 1)), F.lit(dt.date(2000, 6, 30))))
    save_roles(Some(spark, sf_small), path, roles=["forecast"], partition_by_date=True)
    return StoredWarehouse(spark, path)


@pytest.mark.parametrize("state_of, latest", [(DEDUP, "snapshot_date"), (CURRENT, "recent_date")])
def test_state_and_one_new_file_equal_the_full_run(spark, stored, tmp_path, state_of, latest):
    path = str(tmp_path / "state")
    dates = sorted(r[0] for r in stored.forecast.select("file_date").distinct().collect())
    assert len(dates) == 12 and read_state(spark, path) is None and files_of(spark, path) == []
    assert advance(stored, path, dates[:-1], state_of, latest) == dates[:-1]
    assert bag(read_state(spark, path)) == bag(state_of(stored.forecast.where(F.col("file_date") < F.lit(dates[-1]))))
    assert advance(stored, path, dates, state_of, latest) == dates[-1:]
    assert files_of(spark, path) == dates
    full = state_of(stored.forecast)
    assert bag(read_state(spark, path)) == bag(full) and full.count() > 10
    assert advance(stored, path, dates, state_of, latest) == []
    if latest == "recent_date":
        got = forecast.current_forecast_of(read_state(spark, path), FIXTURE.as_of, region_override=FIXTURE.region_override)
        want = forecast.current_forecast(stored.forecast, FIXTURE.as_of, rules=FIXTURE.forecast_rules, region_override=FIXTURE.region_override)
        assert bag(got) == bag(want) and got.columns == want.columns


def test_a_new_file_reads_only_itself(spark, stored):
    day = dt.date(2000, 6, 15)
    df = DEDUP(stored.between("forecast", "file_date", day, day))
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[[^\]]*file_date[^\]]*2000-06-15", text)
    assert {r[0] for r in stored.between("forecast", "file_date", day, day).select("file_date").distinct().collect()} == {day}


def test_states_merge_in_any_order_and_twice(spark, stored):
    parts = [DEDUP(stored.forecast.where(F.month("file_date") == m)) for m in (3, 1, 6, 2, 5, 4)]
    want = bag(DEDUP(stored.forecast))
    assert bag(forecast.merge_states(parts, "snapshot_date")) == want
    assert bag(forecast.merge_states([*parts, parts[0], DEDUP(stored.forecast)], "snapshot_date")) == want


@pytest.mark.parametrize("name", ["snapshot_dedup", "current_forecast"])
def test_merged_reports_equal_the_plain_ones(spark, sf_small, name):
    wh = Warehouse(spark, sf_small)
    assert bag(present(REPORTS[name + "_merged"](wh, FIXTURE))) == bag(present(REPORTS[name](wh, FIXTURE)))
