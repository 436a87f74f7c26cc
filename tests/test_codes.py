"""Padded codes: with trim_codes the reports equal those over unpadded inputs."""

from pyspark.sql import functions as F

from tradewind.plans import FIXTURE, REPORTS, present
from tradewind.sources import Warehouse

PADDED = {"orders": ["o_orderpriority", "o_orderstatus"], "customer": ["c_mktsegment"], "part": ["p_type", "p_name"]}


def test_trailing_blanks_are_ignored_with_trim_codes(spark, sf_small):
    def padded_reader(s, name):
        df = s.read.parquet(f"{sf_small}/{name}.parquet")
        for c in PADDED.get(name, []):
            df = df.withColumn(c, F.concat(F.col(c), F.lit("  ")))
        return df

    clean = Warehouse(spark, sf_small)
    padded = Warehouse(spark, sf_small, reader=padded_reader, trim_codes=True)
    for name in ("marketing_dashboard", "order_type_pivot", "forecast_vs_actual"):
        want = sorted(map(tuple, present(REPORTS[name](clean, FIXTURE)).collect()), key=repr)
        got = sorted(map(tuple, present(REPORTS[name](padded, FIXTURE)).collect()), key=repr)
        assert got == want, name


def test_codes_of_any_case_are_one_group_with_a_defined_spelling(spark, sf_small):
    """Codes are compared without case, and shown as the source spells them first in code-point order."""
    wh = Warehouse(spark, sf_small)
    folded = present(REPORTS["order_type_pivot_any_case"](wh, FIXTURE)).collect()
    spelled = present(REPORTS["order_type_pivot_spelled"](wh, FIXTURE)).collect()
    text = [c for c, t in present(REPORTS["order_type_pivot_spelled"](wh, FIXTURE)).dtypes if t == "string"]
    low = lambda rows: sorted((tuple(v.lower() if c in text and v is not None else v for c, v in r.asDict().items()) for r in rows), key=repr)
    assert low(folded) == low(spelled) and len({r.forecast_group for r in spelled}) == len({r.forecast_group for r in folded})
    mixed = wh.mixed_case()
    source = {r[0] for r in mixed._reader(spark, "customer").select("c_mktsegment").distinct().collect()} | {"HOME", "AUTO"}
    assert any(s != s.lower() for s in source) and {r.forecast_group for r in spelled} <= source
    for r in mixed.spellings("accounts", "forecast_group", ["HOME", "AUTO"]).collect():
        assert r.spelling == min(s for s in source if s.lower() == r.code)
