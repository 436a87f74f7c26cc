"""Sheet sources and sinks: file read with schema, positional select, JSON transport, roll-up, file sink."""

import os
import tempfile

from pyspark.sql import functions as F

from tradewind.operators import sheet
from tradewind.sources import (Warehouse, read_sheet, select_positions, sheet_to_json_arrays, sheet_to_json_rows, shred_json_arrays,
                               shred_json_rows, typed_sheet, write_report)
from tradewind.sources import roles

MONTHS = ("apr", "may", "jun")


def _edge_sheet(spark):
    # leading label column, two id columns, UPC, three months (one float, NULLs, a duplicate UPC row,
    # a UPC unknown to the bridge)
    rows = [("r1", "A1", "V1", 100, 4.0, None, 2.0),
            ("r2", "A1", "V1", 100, 4.0, None, 2.0),
            ("r3", "A2", "V2", 200, 1.0, 5.0, None),
            ("r4", "A3", "V3", 999, 7.0, 7.0, 7.0),
            ("r5", "A4", "V4", 300, None, None, None)]
    return spark.createDataFrame(rows, "label string, asin string, vendor string, upc bigint, apr double, "
                                       "may double, jun double")


def test_positions_json_roundtrip_and_typing(spark):
    sh = select_positions(_edge_sheet(spark), range(1, 7))
    assert sh.columns == ["asin", "vendor", "upc", "apr", "may", "jun"]
    shredded = shred_json_rows(sheet_to_json_rows(sh, MONTHS), "upc", MONTHS)
    typed = typed_sheet(sh, "upc", MONTHS)
    assert [f.dataType.simpleString() for f in shredded.schema.fields] == ["bigint", "int", "int", "int"]
    assert sorted(map(tuple, shredded.collect()), key=repr) == sorted(map(tuple, typed.collect()), key=repr)
    assert (100, 4, None, 2) in [tuple(r) for r in shredded.collect()]
    arrays = sheet_to_json_arrays(sh, MONTHS, rows_per_array=2)
    assert arrays.count() >= 3
    assert sorted(map(tuple, shred_json_arrays(arrays, "upc", MONTHS).collect()), key=repr) == sorted(map(tuple, typed.collect()), key=repr)


def test_rollup_distinct_at_upc_grain(spark):
    sh = typed_sheet(select_positions(_edge_sheet(spark), range(1, 7)), "upc", MONTHS)
    bridge = spark.createDataFrame([(100, "11"), (200, "11"), (300, "12")], "upc bigint, material string")
    material = spark.createDataFrame([("11", "boot"), ("12", "sock")], "material string, material_description string")
    line_list = spark.createDataFrame([("11", "Fall 2022")], "material string, season string")
    out = sheet.sheet_rollup(sh, bridge, material, line_list, months=MONTHS, season="Fall 2022")
    got = [tuple(r) for r in out.collect()]
    # UPC 100 listed twice with equal numbers counts once; UPC 999 has no bridge row; first month desc
    assert got == [(11, "boot", "INLINE", 5, 5, 2), (12, "sock", "DISCO", None, None, None)]


def test_read_sheet_and_write_report_round_trip(spark):
    out_dir = tempfile.mkdtemp(prefix="tradewind-sheet-")
    src = _edge_sheet(spark)
    write_report(src, os.path.join(out_dir, "csv"), fmt="csv")
    schema = "label string, asin string, vendor string, upc bigint, apr double, may double, jun double"
    back = read_sheet(spark, os.path.join(out_dir, "csv"), schema=schema, fmt="csv")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, src.collect()), key=repr)
    write_report(src.withColumn("part", F.col("upc") % 2), os.path.join(out_dir, "pq"), partition_by=["part"])
    pq = read_sheet(spark, os.path.join(out_dir, "pq"), schema, fmt="parquet")
    assert pq.count() == src.count()


def test_rollup_joins_a_material_with_several_names_and_copies(spark):
    sh = typed_sheet(select_positions(_edge_sheet(spark), range(1, 7)), "upc", MONTHS)
    bridge = spark.createDataFrame([(100, "11"), (100, "11"), (200, "11"), (200, "12"), (300, None)], "upc bigint, material string")
    material = spark.createDataFrame([("11", "boot"), ("11", "boot"), ("11", None), ("12", "sock"), (None, "none")],
                                     "material string, material_description string")
    line_list = spark.createDataFrame([("11", "Fall 2022"), ("11", "Fall 2022"), (None, "Fall 2022")], "material string, season string")
    out = sheet.sheet_rollup(sh, bridge, material, line_list, months=MONTHS, season="Fall 2022")
    assert sorted(map(tuple, out.collect()), key=repr) == [
        (11, "boot", "INLINE", 5, 5, 2), (11, None, "INLINE", 5, 5, 2), (12, "sock", "DISCO", 1, 5, None)]


def _lines(spark, rows):
    """Lines of 40 parts and as many suppliers, null keys and one UPC that every third line has."""
    hot = F.col("id") % 3 == 0
    return spark.range(rows).select(
        F.col("id").alias("l_orderkey"),
        F.when(hot, 7).when(F.col("id") % 11 == 1, None).otherwise(F.col("id") % 40).cast("bigint").alias("l_partkey"),
        F.when(hot, 7).when(F.col("id") % 13 == 1, None).otherwise(F.col("id") % 41).cast("bigint").alias("l_suppkey"),
        F.when(F.col("id") % 17 != 2, F.col("id") % 9).cast("double").alias("l_quantity"),
        F.expr("timestamp_ntz '1999-01-15' + make_interval(0, id % 12)").alias("l_shipdate"))


def _lines_warehouse(spark, rows):
    return Warehouse(spark, "/none", reader=lambda _, name: {"lineitem": _lines(spark, rows)}[name])


def test_sheet_and_bridge_tasks_follow_the_lines(spark, monkeypatch):
    monkeypatch.setattr(roles, "LINES_PER_TASK", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("2", "5"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            for rows in (1_000, 3_000):
                wh = _lines_warehouse(spark, rows)
                assert wh.line_tasks() == rows // 100
                assert wh.forecast_sheet.rdd.getNumPartitions() == wh.upc_bridge.rdd.getNumPartitions() == rows // 100
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sheet_and_bridge_hold_the_groups_of_all_lines(spark, monkeypatch):
    monkeypatch.setattr(roles, "LINES_PER_TASK", 300)
    wh, lines = _lines_warehouse(spark, 3_000), [tuple(r) for r in _lines(spark, 3_000).collect()]
    want = {}
    for _, part, supp, quantity, day in lines:
        upc = None if part is None or supp is None else f"{part}{supp:019d}"
        cells = want.setdefault((upc, None if supp is None else f"V{supp}"), {})
        if quantity is not None and 4 <= day.month <= 10:
            cells[day.month] = cells.get(day.month, 0) + quantity / 2
    got = wh.forecast_sheet.collect()
    assert len(got) == len(want)
    for r in got:
        assert [r[f"m{m:02d}"] for m in range(4, 11)] == [want[r["upc"], r["vendor_code"]].get(m) for m in range(4, 11)]
        assert r["sheet_line"] == r["upc"] and r["asin"] == (None if r["upc"] is None else f"A{r['upc']}")
    bridge = {(None if p is None or s is None else f"{p}{s:019d}", None if p is None else str(p)) for _, p, s, _, _ in lines}
    assert sorted(map(tuple, wh.upc_bridge.collect()), key=repr) == sorted(bridge, key=repr)
