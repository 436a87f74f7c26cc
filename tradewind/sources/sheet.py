"""The monthly forecast sheet: read, positional projection, JSON transport, typed staging, file sink.

The reference moves a spreadsheet into the database as a JSON array and shreds it with typed paths.
Here the exported sheet is a CSV or Parquet file read by Spark with an explicit schema; the JSON
transport survives as a per-row ``to_json`` / ``from_json`` pair (JVM-side, no Python per row) so
that loading sheets that arrive as JSON keeps the same typing rules.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .versions import current, new_version, switch


def read_sheet(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv") -> DataFrame:
    """Read an exported sheet with its ``schema`` (nothing is inferred).  CSV needs a header row."""
    reader = spark.read.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true").option("mode", "FAILFAST")
    return reader.load(path)


def select_positions(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Keep columns by position (the sheet's first column is a label that is dropped)."""
    names = df.columns
    return df.select(*[F.col(f"`{names[i]}`") for i in positions])


def _whole(df: DataFrame, measure_cols: Sequence[str]) -> Column:
    """A row as a struct, measures rounded to whole numbers (an integer field would not accept ``4.0``)."""
    return F.struct(*[F.round(F.col(c)).cast("bigint").alias(c) if c in measure_cols else F.col(c) for c in df.columns])


def sheet_to_json_rows(df: DataFrame, measure_cols: Sequence[str]) -> DataFrame:
    """One JSON object per row."""
    return df.select(F.to_json(_whole(df, measure_cols)).alias("json"))


def sheet_to_json_arrays(df: DataFrame, measure_cols: Sequence[str], rows_per_array: int = 1000) -> DataFrame:
    """JSON arrays of at most ``rows_per_array`` objects."""
    row = df.select(_whole(df, measure_cols).alias("row"), F.expr(f"monotonically_increasing_id() div {int(rows_per_array)}").alias("part"))
    return row.groupBy("part").agg(F.to_json(F.collect_list("row")).alias("json")).select("json")


def _fields(id_col: str, measure_cols: Sequence[str], id_type: str) -> T.StructType:
    ids = {"bigint": T.LongType(), "string": T.StringType()}
    return T.StructType([T.StructField(id_col, ids[id_type])] + [T.StructField(c, T.LongType()) for c in measure_cols])


def shred_json_rows(rows: DataFrame, id_col: str, measure_cols: Sequence[str],
                    id_type: str = "bigint", measure_type: str = "int") -> DataFrame:
    """Typed shred of JSON objects: only the named fields survive, each cast to its declared type."""
    parsed = rows.select(F.from_json("json", _fields(id_col, measure_cols, id_type)).alias("r")).select("r.*")
    return parsed.select(id_col, *[F.col(c).cast(measure_type).alias(c) for c in measure_cols])


def shred_json_arrays(rows: DataFrame, id_col: str, measure_cols: Sequence[str],
                      id_type: str = "bigint", measure_type: str = "int") -> DataFrame:
    """Typed shred of JSON arrays: one row per element of every array."""
    parsed = rows.select(F.inline(F.from_json("json", T.ArrayType(_fields(id_col, measure_cols, id_type)))))
    return parsed.select(id_col, *[F.col(c).cast(measure_type).alias(c) for c in measure_cols])


def typed_sheet(df: DataFrame, id_col: str, measure_cols: Sequence[str],
                id_type: str = "bigint", measure_type: str = "int") -> DataFrame:
    """Staging-table projection: id plus month columns, cast to the declared types."""
    return df.select(F.col(id_col).cast(id_type).alias(id_col),
                     *[F.round(F.col(c)).cast(measure_type).alias(c) for c in measure_cols])


def publish_report(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write a finished report as a new version below ``path`` and make it the current one.

    A run that is lost before the switch leaves the old report readable (see ``versions``).
    """
    version = new_version(path)
    write_report(df, version, fmt, partition_by)
    switch(df.sparkSession, path, version, format=fmt, schema=df.schema.json())


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a published report."""
    told = current(spark, path)
    if told is None:
        raise FileNotFoundError(f"no report has been published below {path}")
    return read_sheet(spark, told["version"], T.StructType.fromJson(json.loads(told["schema"])), told["format"])


def write_report(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """File sink for a finished report (Parquet by default; CSV gets a header row).

    It replaces what the folder holds; :func:`publish_report` keeps the old report until the new one is whole.
    """
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
