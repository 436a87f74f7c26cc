"""Every registered query against its independent DuckDB SQL (row count, columns, values)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import duck, rows_of  # noqa: E402

from tradewind.plans import REPORTS  # noqa: E402

NAMES = list(REPORTS)


def test_every_report_is_registered_with_oracle_sql():
    assert set(NAMES) <= set(E.queries()) and set(NAMES) <= set(E.oracle_sql()) <= set(E.queries())


def test_oracle_shares_only_parameter_values_with_the_reports():
    import tradewind.oracle as package
    folder = os.path.dirname(package.__file__)
    for name in os.listdir(folder):
        if name.endswith(".py"):
            with open(os.path.join(folder, name)) as f:
                text = f.read()
            assert "..functions" not in text and "..operators" not in text and "..sources" not in text


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.entry(spark).columns


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, sf_small, name):
    sdf = E.queries()[name](spark, sf_small)
    rel = con.sql(E.oracle_sql()[name])
    s_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    d_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    type_map = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
    assert {c: type_map.get(t, t) for c, t in s_types.items()} == d_types
    scols, srows = rows_of(sdf.toPandas())
    dcols, drows = rows_of(rel.df())
    assert scols == dcols
    assert sum(srows.values()) == sum(drows.values())
    assert srows == drows
