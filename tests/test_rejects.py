"""Values that a typed reading loses are counted, kept with their reason, or an error."""

import json

import pytest
from pyspark.sql import functions as F

from tradewind.__main__ import main
from tradewind.functions import safe_int, season_year
from tradewind.sources import Warehouse, accepted, audit_roles, insist, json_object, observed, read_report, rejected, season_label, whole_number

ROWS = [("100", "Fall 2021"), ("Other", "Fall 2021"), ("12.5", "Carryover"), ("", "Spring"), (None, None), ("9" * 30, "spring 2020"), (" 7 ", "Fall 20x1"),
        ("100", "Fall 2021")]
RULES = (whole_number("material"), season_label("season", ("carryover",)))


@pytest.fixture()
def table(spark):
    return spark.createDataFrame(ROWS, "material string, season string")


def test_rejected_rows_and_reasons(table):
    got = sorted((r.column, r.reason, r.value, json.loads(r.row)["season"]) for r in rejected(table, RULES).collect())
    assert got == sorted([("material", "no whole number", "Other", "Fall 2021"), ("material", "no whole number", "12.5", "Carryover"),
                          ("material", "no whole number", "", "Spring"), ("material", "no whole number", "9" * 30, "spring 2020"),
                          ("season", "no year", "Spring", "Spring"), ("season", "no year", "Fall 20x1", "Fall 20x1")])
    assert rejected(table.limit(0), RULES).count() == 0


def test_rules_hold_exactly_where_the_reading_loses_a_value(table):
    """Against the functions that the reports read with (an overflow is an error there)."""
    fits = table.where("material IS NULL OR length(material) < 20")
    lost = rejected(fits, RULES[:1]).count()
    assert lost == fits.where(F.col("material").isNotNull() & safe_int("material").isNull()).count() == 3
    assert rejected(table, (season_label("season"),)).count() == table.where(F.col("season").isNotNull() & season_year("season").isNull()).count() == 3


def test_counts_come_with_the_rows(table):
    df, seen = observed(table, RULES)
    assert df.count() == len(ROWS)
    assert seen.get == {"rows": len(ROWS), "material: no whole number": 4, "season: no year": 2}
    assert accepted(table, RULES).count() == 3 and accepted(table, ()).count() == len(ROWS)


def test_a_lost_value_is_an_error_where_it_is_insisted(table):
    with pytest.raises(Exception, match="no whole number|no year"):
        insist(table, RULES).collect()
    assert insist(accepted(table, RULES), RULES).count() == 3


def test_json(spark):
    texts = ['{"upc": 1, "apr": 4}', '{"upc": 1, "apr": "four"}', "{broken", "[1]", None, '{"other": 1}', '{"upc": 1, "apr": null}']
    df = spark.createDataFrame([(t,) for t in texts], "json string")
    assert sorted(r.value for r in rejected(df, (json_object("json", "upc bigint, apr int"),)).collect()) == sorted([texts[1], texts[2], texts[3]])


def test_audit_of_all_roles(spark, sf_small, tmp_path, capsys):
    main(["audit", sf_small, str(tmp_path / "good")], spark=spark)
    told = json.loads(capsys.readouterr().out)
    assert told["sales_fact"] == {"rows": 6000, "material: no whole number": 0}
    assert all(n == 0 for counts in told.values() for name, n in counts.items() if name != "rows")
    assert read_report(spark, str(tmp_path / "good" / "line_list")).count() == 0

    class Bad(Warehouse):
        @property
        def line_list(self):
            own = Warehouse.line_list.fget(self)
            return own.withColumn("season", F.when(F.col("season") == "Fall 2000", "Autumn").otherwise(F.col("season")))
    bad = Bad(spark, sf_small)
    want = bad.line_list.where("season = 'Autumn'").count()
    told = audit_roles(bad, str(tmp_path / "bad"))
    assert told["line_list"]["season: no year"] == want > 0
    found = read_report(spark, str(tmp_path / "bad" / "line_list"))
    assert found.count() == want and {(r.column, r.reason, r.value) for r in found.collect()} == {("season", "no year", "Autumn")}
