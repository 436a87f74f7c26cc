"""Stored role tables for production runs.

Deriving the role views from raw tables repeats the large fact-to-order-to-customer joins in every
report.  A deployment can write each role once per load and run the reports over the stored copies:
``StoredWarehouse`` has the same role attributes as ``Warehouse``, so every plan in ``plans.reports``
runs unchanged on either.

Layout per role, as ``save_roles`` is told:

* By default fact roles are range-partitioned on (date, material), where the date is the column the
  reports filter on (sales by transaction date, open orders by cancel date, inventory by availability
  date, sell-through by week, forecast by file date).  Each output file covers a narrow date range and
  rows are sorted by (date, material) inside it, so the pushed date filters of trailing windows skip
  whole files and row groups by their min/max statistics.  A date holding a large share of the rows is
  still split over several writer tasks by material.
* ``partition_by_date`` additionally writes one directory per date, so the same filters prune
  directories before any file is opened, and joins on the date prune them by the other side's rows at run
  time.  That suits large loads (a day of a 100 TB fact is tens of GB) and roles with few dates, such as
  the forecast files; on small data it only creates thousands of tiny files.
* ``buckets`` co-partitions roles on the key they meet on: the order for open orders and the narrow sales
  orders, the material for the others.  Joins and groupings on that key need no exchange.  Rows are sorted
  by date inside a bucket, so date filters still skip row groups.  A bucket is read by one task, so a role
  whose fullest bucket would hold over ``MOST_OF_A_BUCKET`` times the mean (a hot key) is stored in the
  default layout, where adaptive execution divides the key.

A role's version counts from the moment its pointer is switched (``versions``), which also names the
layout, the schema and the measured reach of the derived dates (``derived``).
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import TableStore
from .derived import Derived, bounded, days_after, measure
from .roles import DERIVED, Warehouse
from .versions import current, new_version, switch

# role -> date column that orders the files, or names the directories (None: neither)
LAYOUT: dict[str, str | None] = {
    "sales_fact": "transaction_dt",
    "sales_orders": None,
    "open_orders": "cancel_dt",
    "available_to_sell": "avail_dt",
    "sell_through": "week_start",
    "forecast": "file_date",
    "selected_snapshots": None,
    "line_list": None,
    "style_master": None,
    "calendar": None,
    "upc_bridge": None,
    "forecast_sheet": None,
}

# role -> key of its buckets
BUCKET_KEYS: dict[str, str] = {"sales_orders": "order_id", "open_orders": "order_id"} | {
    role: "material" for role in ("sales_fact", "available_to_sell", "sell_through", "forecast", "line_list", "style_master")}

MOST_OF_A_BUCKET = 4.0


def save_roles(wh: Warehouse, path: str, roles: Iterable[str] | None = None, partition_by_date: bool | Iterable[str] = False,
               buckets: int | None = None) -> None:
    """Write role views of ``wh`` under ``path/<role>``, see the module's text for the layouts.

    ``partition_by_date`` holds for all roles with a date, or for the roles named; those have no buckets.
    The range partitions are sized at run time (``spark.sql.adaptive``).  A run that is lost at any moment
    leaves the old copy of the role it was writing as the one that is read.
    """
    spark = wh.spark
    for role in roles or LAYOUT:
        df, date = getattr(wh, role), LAYOUT[role]
        dated = date is not None and (partition_by_date if isinstance(partition_by_date, bool) else role in partition_by_date)
        key = BUCKET_KEYS.get(role) if buckets and not dated else None
        target = f"{path.rstrip('/')}/{role}"
        version = new_version(target)
        bucketed = key is not None and key in df.columns and _even(df, key, buckets)
        if bucketed:
            _write_buckets(df, version, key, buckets, [c for c in (date, key) if c])
        else:
            order = [c for c in (date, "material") if c and c in df.columns]
            rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
            writer = rows.write
            (writer.partitionBy(date) if dated else writer).parquet(version)
        stored = spark.read.schema(df.schema).parquet(version)
        reach = {} if date is None else measure(stored, date, [c for c in DERIVED.get(role, {}) if c != date and c in df.columns])
        switch(spark, target, version, schema=df.schema.json(), reach=reach, buckets=[key, buckets] if bucketed else None)


def _even(df: DataFrame, key: str, buckets: int) -> bool:
    """No bucket has many times the mean (buckets are numbered as the writer does it)."""
    sizes = df.groupBy(F.pmod(F.hash(key), F.lit(buckets)).alias("b")).agg(F.count("*").alias("n"))
    most, rows = sizes.agg(F.max("n"), F.sum("n")).first()
    return rows is None or most <= max(MOST_OF_A_BUCKET * rows / buckets, 1000)


def _table_name(version: str) -> str:
    return "tradewind_" + hashlib.sha256(version.encode("utf-8")).hexdigest()[:24]


def _write_buckets(df: DataFrame, version: str, key: str, buckets: int, order: list[str]) -> None:
    """One file a bucket, sorted by ``order`` (the table entry is external and dropped again)."""
    name = _table_name(version)
    # the same hash as the buckets', so that a task writes one file
    rows = df.repartition(buckets, key).sortWithinPartitions(*order)
    rows.write.format("parquet").bucketBy(buckets, key).option("path", version).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


class StoredWarehouse:
    """Role views read from tables written by :func:`save_roles`."""

    def __init__(self, spark: SparkSession, path: str, store_dir: str | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self._roles: dict[str, DataFrame] = {}
        self._told: dict[str, dict] = {}
        self.tables = TableStore(spark, store_dir) if store_dir else None

    keep = Warehouse.keep
    close = Warehouse.close

    def between(self, role: str, column: str, first: _dt.date | None = None, last: _dt.date | None = None) -> DataFrame:
        """The rows of a role whose date is from ``first`` to ``last``; the bounds also reach the date that
        the role's files are ordered by, as far as was measured when they were written."""
        df = getattr(self, role)
        stored = "forecast" if role == "forecast_history" else role
        return bounded(df, column, self._derived(stored, column), first, last)

    def _derived(self, role: str, column: str) -> Derived | None:
        reach = self._facts(role)["reach"].get(column)
        return days_after(LAYOUT[role], *reach) if reach else None

    def of_season(self, season: str) -> DataFrame:
        return self.line_list.where(F.col("season") == season)

    def snapshots_between(self, first: _dt.date, last: _dt.date) -> DataFrame:
        """A stored table of known size: Spark broadcasts it below its threshold, and the rows then prune the
        directories of the forecast files at run time."""
        return bounded(self.selected_snapshots, "file_date", None, first, last)

    def calendar_of(self, role: str, column: str, first: _dt.date | None = None, last: _dt.date | None = None) -> DataFrame:
        return self.calendar

    def _facts(self, role: str) -> dict:
        if role not in self._told:
            told = current(self.spark, f"{self.path}/{role}")
            if told is None:
                raise FileNotFoundError(f"no stored role {role!r} below {self.path}")
            self._told[role] = told
        return self._told[role]

    def _read(self, role: str) -> DataFrame:
        if role not in self._roles:
            told = self._facts(role)
            schema = T.StructType.fromJson(json.loads(told["schema"]))
            if told["buckets"]:
                df = self._bucketed(told["version"], schema, *told["buckets"])
            else:
                df = self.spark.read.schema(schema).parquet(told["version"])
            self._roles[role] = df.select(*schema.names)
        return self._roles[role]

    def _bucketed(self, version: str, schema: T.StructType, key: str, buckets: int) -> DataFrame:
        """The files of a bucketed version as an external table of this session's catalog."""
        name = _table_name(version)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{version}'")
        return self.spark.table(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in LAYOUT:
            return self._read(name)
        raise AttributeError(name)

    @property
    def forecast_history(self) -> DataFrame:
        return self._read("forecast").withColumnRenamed("forecast_group", "sales_group")

    @property
    def material(self) -> DataFrame:
        return self._read("style_master").select("material", "material_description")
