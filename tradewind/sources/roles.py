"""Role views: the source relations the reports read, derived from the input tables.

In production these are warehouse views; here each role is a lazy DataFrame over the Parquet tables
in ``sf_dir`` (see FIXTURES.md §2 for the definitions).  Column pruning and predicate pushdown reach the
Parquet scans through the role definitions.
"""

from __future__ import annotations

import copy
import datetime as _dt
import functools
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import MONEY
from ..session import TableStore
from .derived import Derived, bounded, days_after, months_after, small_side, week_of

#: snapshots that a plan may hold by value
MOST_SNAPSHOTS = 20_000

#: lines that one task groups by UPC (a UPC has about one line, so a task holds about as many groups)
LINES_PER_TASK = 250_000

#: tasks that the lines of one UPC are dealt over before their sums meet in one
UPC_SHARES = 8


def _sd() -> Column:
    return F.col("l_shipdate").cast("date")


def _qty() -> Column:
    return F.col("l_quantity").cast("bigint")


def _amt() -> Column:
    return F.col("l_extendedprice").cast(MONEY)


def _material() -> Column:
    return F.col("l_partkey").cast("string")


def _upc() -> Column:
    """Digits of the part and, in a fixed width, of the supplier: one text per pair at any scale."""
    return F.concat(F.col("l_partkey").cast("string"), F.lpad(F.col("l_suppkey").cast("string"), 19, "0"))


def _file_date() -> Column:
    return F.date_add(F.trunc(_sd(), "MM"), (F.col("l_suppkey") % 2).cast("int") * 14)


def _module() -> Column:
    return F.when(F.col("l_returnflag") == "R", F.lit("SalesForecast")).otherwise(F.lit("Demand"))


def _half(d: Column) -> Column:
    return F.when(F.month(d) <= 6, F.lit("Spring-Summer")).otherwise(F.lit("Fall-Winter"))


def _plant() -> Column:
    return F.when(F.col("l_suppkey") % 2 == 0, F.lit("P1")).otherwise(F.lit("P2"))


def _gender() -> Column:
    return F.when(F.col("p_size") % 2 == 0, F.lit("Mens")).otherwise(F.lit("Womens"))


def _sales_org() -> Column:
    return F.when(F.col("n_regionkey") != 0, F.lit("US")).otherwise(F.lit("INTL"))


#: line numbers that the reach of a derived date is declared for; any other line is never left out
LINES = (1, 7)


def _other_lines() -> Column:
    return (F.col("l_linenumber") < LINES[0]) | (F.col("l_linenumber") > LINES[1])


def _file_of(source: str) -> Derived:
    """File dates: the first of the source's month, or 14 days from it."""
    month, fortnight = months_after(source, 0, 0), _dt.timedelta(days=14)
    return Derived(source, lambda d: month.earliest(max(d, _dt.date(1, 1, 15)) - fortnight),
                   lambda d: month.latest(min(d, _dt.date(9999, 12, 1)) + fortnight))


#: role -> its dates that follow from the ship date of its lines
DERIVED: dict[str, dict[str, Derived]] = {
    "sales_fact": {"transaction_dt": days_after("l_shipdate", 0, 0),
                   "request_ship_dt": days_after("l_shipdate", 10 * LINES[0], 10 * LINES[1], _other_lines)},
    "open_orders": {"afs_req_dt": days_after("l_shipdate", 0, 0), "sched_req_dt": days_after("l_shipdate", 21, 21),
                    "req_deliv_dt": days_after("l_shipdate", 28, 28),
                    "cancel_dt": days_after("l_shipdate", 5 * LINES[0], 5 * LINES[1], _other_lines)},
    "available_to_sell": {"avail_dt": days_after("l_shipdate", 0, 0)},
    "sell_through": {"week_start": week_of("l_shipdate")},
    "forecast": {"file_date": _file_of("l_shipdate"), "demand_date": months_after("l_shipdate", *LINES, _other_lines)},
    "selected_snapshots": {"file_date": _file_of("l_shipdate")},
    "calendar": {"the_date": days_after("l_shipdate", 0, 0)},
}
DERIVED["forecast_history"] = DERIVED["forecast"]

TableReader = Callable[[SparkSession, str], DataFrame]


def parquet_reader(location: str) -> TableReader:
    """Tables stored as ``<location>/<name>.parquet``."""
    base = location.rstrip("/")
    return lambda spark, name: spark.read.parquet(f"{base}/{name}.parquet")


def jdbc_reader(url: str, properties: dict[str, str], partitioning: dict[str, tuple[str, int, int, int]],
                whole: tuple[str, ...] = ("region", "nation")) -> TableReader:
    """Tables read over JDBC.  ``partitioning[name] = (column, lower, upper, partitions)`` splits a table
    into parallel range reads on a numeric column (one connection per partition).  Only the small tables
    named in ``whole`` may be read over a single connection; any other table must be partitioned."""
    def read(spark: SparkSession, name: str) -> DataFrame:
        if name in partitioning:
            column, lower, upper, n = partitioning[name]
            return spark.read.jdbc(url, name, column=column, lowerBound=lower, upperBound=upper,
                                   numPartitions=n, properties=properties)
        if name not in whole:
            raise ValueError(f"table {name!r} would be read by one task; give its partitioning")
        return spark.read.jdbc(url, name, properties=properties)
    return read


def mixed_case_reader(inner: TableReader) -> TableReader:
    """Test input: the same tables with the letter case of their codes changed on every other row."""
    codes = {"customer": ("c_mktsegment", "c_custkey"), "orders": ("o_orderpriority", "o_orderkey"), "part": ("p_type", "p_partkey")}

    def read(spark: SparkSession, name: str) -> DataFrame:
        df = inner(spark, name)
        if name not in codes:
            return df
        code, key = codes[name]
        return df.withColumn(code, F.when(F.col(key) % 2 == 0, F.lower(code)).otherwise(F.initcap(code)))
    return read


def role(build: Callable[["Warehouse"], DataFrame]) -> property:
    """A role view: built once per Warehouse, with the Warehouse's text normalisation applied."""
    name = build.__name__

    @functools.wraps(build)
    def get(self: "Warehouse") -> DataFrame:
        if name not in self._roles:
            self._roles[name] = self._normalise(build(self))
        return self._roles[name]
    return property(get)


def season_dates(season: str) -> tuple[_dt.date, _dt.date] | None:
    """First and last ship date of the lines of a season ("Spring 2000", "Fall 2000"); None for any other text."""
    found = re.fullmatch(r"(spring|fall) ([0-9]{4})", season.lower())
    if not found or found[2] == "0000":
        return None
    year = int(found[2])
    return (_dt.date(year, 1, 1), _dt.date(year, 6, 30)) if found[1] == "spring" else (_dt.date(year, 7, 1), _dt.date(year, 12, 31))


class Warehouse:
    """Lazy role views over the input tables of one location (Parquet by default).

    ``trim_codes`` removes trailing blanks from every text column of the roles, so padded codes
    compare, join and group equal to unpadded ones as in the source warehouse.  ``fold_case`` puts every
    text column of the roles in lower case; with ``Params.folded()``, which does the same to the
    parameters, codes are equal whatever their case; ``spellings`` gives them back as they are written.  Both are off by default: untouched text columns keep
    their filters pushable into the Parquet scan.

    ``store_dir`` names a shared folder for intermediate tables.  With it, reports that use a result
    several times write it there once (``keep``), and ``close`` deletes the tables; without it every
    report is one lazy plan.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, reader: TableReader | None = None,
                 trim_codes: bool = False, fold_case: bool = False, store_dir: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._reader = reader or parquet_reader(self.sf_dir)
        self._tables: dict[str, DataFrame] = {}
        self._roles: dict[str, DataFrame] = {}
        self._line_tasks: int | None = None
        self.trim_codes = trim_codes
        self.fold_case = fold_case
        self.tables = TableStore(spark, store_dir) if store_dir else None

    def keep(self, *dfs: DataFrame) -> list[DataFrame]:
        """The same rows, stored once where this Warehouse has a folder for it."""
        return self.tables.keep_all(dfs) if self.tables else list(dfs)

    def close(self) -> None:
        if self.tables:
            self.tables.close()

    def mixed_case(self) -> "Warehouse":
        """Test view of this Warehouse: codes in mixed case, compared whatever their case."""
        return Warehouse(self.spark, self.sf_dir, mixed_case_reader(self._reader), self.trim_codes, fold_case=True)

    def spellings(self, role: str, column: str, also: Sequence[str] = ()) -> DataFrame:
        """(code, spelling): how each code of a folded role's column is spelled in the source.

        Of several spellings it is the first in code-point order, so it does not depend on the order of the
        rows.  ``also`` are codes that do not stand in the source, such as the targets of rules.
        """
        plain = Warehouse(self.spark, self.sf_dir, self._reader)
        own = getattr(plain, role).select(F.col(column).alias("spelling"))
        if also:
            own = own.unionAll(self.spark.createDataFrame([(a,) for a in also], "spelling string"))
        text = F.rtrim("spelling") if self.trim_codes else F.col("spelling")
        text = text.alias("spelling")
        own = own.select(text).where("spelling IS NOT NULL").distinct()
        return own.groupBy((F.lower("spelling") if self.fold_case else F.col("spelling")).alias("code")).agg(F.min("spelling").alias("spelling"))

    def _normalise(self, df: DataFrame) -> DataFrame:
        if not (self.trim_codes or self.fold_case):
            return df

        def code(c: Column) -> Column:
            c = F.rtrim(c) if self.trim_codes else c
            return F.lower(c) if self.fold_case else c
        return df.select(*[(code(F.col(f"`{f.name}`")) if isinstance(f.dataType, StringType)
                            else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields])

    def table(self, name: str) -> DataFrame:
        """The input table (read once per Warehouse: file listing and footers are not re-read)."""
        if name not in self._tables:
            self._tables[name] = self._reader(self.spark, name)
        return self._tables[name]

    # -- bounds on the roles' dates, which also reach the scan (see ``derived``)
    def between(self, role: str, column: str, first: _dt.date | None = None, last: _dt.date | None = None) -> DataFrame:
        """The rows of a role whose date is from ``first`` to ``last`` (either may be open)."""
        return bounded(getattr(self._reaching(DERIVED[role][column], first, last), role), column, None, first, last)

    def of_season(self, season: str) -> DataFrame:
        """The line list of one season."""
        half = season_dates(season)
        wh = self if half is None else self._reaching(days_after("l_shipdate", 0, 0), *half)
        return wh.line_list.where(F.col("season") == season)

    def snapshots_between(self, first: _dt.date, last: _dt.date) -> DataFrame:
        """The selected snapshots dated from ``first`` to ``last``; each is chosen among all files of its month.

        They are few (months x modules x groups) but stand on the whole fact, so they are counted and held by
        value up to ``MOST_SNAPSHOTS``; the fact is then not shuffled to meet them.
        """
        wh = self._reaching(months_after("l_shipdate", 0, 0), first, last)
        return small_side(bounded(wh.selected_snapshots, "file_date", None, first, last), MOST_SNAPSHOTS)

    def calendar_of(self, role: str, column: str, first: _dt.date | None = None, last: _dt.date | None = None) -> DataFrame:
        """The calendar of the dates on which rows of ``between`` were shipped."""
        return self._reaching(DERIVED[role][column], first, last).calendar

    def _reaching(self, derived: Derived, first: _dt.date | None, last: _dt.date | None) -> "Warehouse":
        """This Warehouse over the lines that reach the bounds."""
        reach = derived.reaches(first, last)
        if reach is None:
            return self
        out = copy.copy(self)
        out._tables, out._roles = {**self._tables, "lineitem": self.table("lineitem").where(reach)}, {}
        out._line_tasks = None
        return out

    # -- shared joins ---------------------------------------------------------------------------
    def _line_customer(self) -> DataFrame:
        """lineitem joined to its order, customer and nation (no orphans in the inputs)."""
        li = self.table("lineitem")
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
        c = self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        n = self.table("nation").select("n_nationkey", "n_name", "n_regionkey")
        return (li.join(o, li.l_orderkey == o.o_orderkey)
                  .join(c, o.o_custkey == c.c_custkey)
                  .join(n, c.c_nationkey == n.n_nationkey))

    def line_tasks(self) -> int:
        """Tasks of about ``LINES_PER_TASK`` lines each; the lines are counted once (Parquet: from the footers)."""
        if self._line_tasks is None:
            self._line_tasks = max(1, -(-self.table("lineitem").count() // LINES_PER_TASK))
        return self._line_tasks

    def _by_upc(self, keys: dict[str, Column], carried: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
        """The lines grouped by UPC and ``keys`` (made of part and supplier), with ``sums`` of what is ``carried`` from
        the line; partitioned by UPC.

        Hardly two lines share a UPC, so the groups that a task holds are about as many as its lines.  The tasks
        follow from the number of lines, not from the size of a file split or the shuffle partitions of the
        session.  The lines of a UPC are summed by their dates in up to ``UPC_SHARES`` tasks before the sums meet in one.
        """
        n, sums = self.line_tasks(), sums or {}
        pair = ["l_partkey", "l_suppkey", "share"]
        share = F.pmod(F.xxhash64("l_shipdate"), F.lit(UPC_SHARES)).cast("int").alias("share")
        lines = self.table("lineitem").select(*pair[:2], share, *[c.alias(name) for name, c in (carried or {}).items()])
        dealt = lines.repartition(n, *pair)
        shares = dealt.groupBy(*pair).agg(*[F.sum(c).alias(name) for name, c in sums.items()]) if sums else dealt.distinct()
        named = shares.select(_upc().alias("upc"), *[c.alias(name) for name, c in keys.items()], *sums).repartition(n, "upc")
        return named.groupBy("upc", *keys).agg(*[F.sum(name).alias(name) for name in sums]) if sums else named.distinct()

    def _with_part(self, df: DataFrame) -> DataFrame:
        p = self.table("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size",
                                      "p_retailprice")
        return df.join(p, df.l_partkey == p.p_partkey)

    # -- roles ----------------------------------------------------------------------------------
    @role
    def sales_fact(self) -> DataFrame:
        df = self._with_part(self._line_customer())
        sd = _sd()
        shipped = F.col("l_linestatus") == "F"
        opened = F.col("l_linestatus") == "O"
        return df.select(
            F.col("l_orderkey").alias("order_id"),
            _material().alias("material"),
            F.col("p_name").alias("material_description"),
            F.col("p_type").alias("category"),
            F.col("c_mktsegment").alias("forecast_group"),
            _sales_org().alias("sales_org"),
            F.col("n_name").alias("region"),
            F.col("o_orderpriority").alias("order_type"),
            F.col("o_orderstatus").alias("order_status"),
            F.when(F.col("l_returnflag") == "R", F.lit(1)).otherwise(F.lit(0)).alias("past_original_ship"),
            sd.alias("transaction_dt"),
            F.year(sd).alias("transaction_year"),
            F.month(sd).alias("transaction_month"),
            F.date_add(sd, F.col("l_linenumber") * 10).alias("request_ship_dt"),
            F.when(shipped, _qty()).otherwise(F.lit(0).cast("bigint")).alias("ship_qty"),
            F.when(shipped, _amt()).otherwise(F.lit(0).cast(MONEY)).alias("ship_amt"),
            F.when(opened, _qty()).otherwise(F.lit(0).cast("bigint")).alias("open_qty"),
            F.when(opened, _amt()).otherwise(F.lit(0).cast(MONEY)).alias("open_amt"),
            F.when(opened & (F.col("l_discount") < 0.05), _qty()).otherwise(F.lit(0).cast("bigint")).alias("ship_open_qty"),
        )

    @role
    def sales_orders(self) -> DataFrame:
        """What names the order of a sales line: a narrow copy of the sales for joins by order."""
        return self.sales_fact.select("order_id", "forecast_group", "sales_org", "order_type")

    @role
    def open_orders(self) -> DataFrame:
        sd = _sd()
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            _material().alias("material"),
            F.col("l_suppkey").alias("cust_po"),
            _plant().alias("plant"),
            sd.alias("afs_req_dt"),
            F.date_add(sd, 21).alias("sched_req_dt"),
            F.date_add(sd, 28).alias("req_deliv_dt"),
            F.date_add(sd, F.col("l_linenumber") * 5).alias("cancel_dt"),
            F.when(F.col("l_linestatus") == "F", F.lit(0).cast("bigint")).otherwise(_qty()).alias("open_qty"),
        )

    @role
    def available_to_sell(self) -> DataFrame:
        df = self._with_part(self.table("lineitem").where(F.col("l_linestatus") == "O"))
        return df.select(
            _plant().alias("plant"),
            _material().alias("material"),
            F.col("p_name").alias("material_description"),
            F.col("p_type").alias("category"),
            _sd().alias("avail_dt"),
            _qty().alias("quantity"),
        )

    @role
    def sell_through(self) -> DataFrame:
        li = self.table("lineitem")
        o = self.table("orders").select("o_orderkey", "o_custkey")
        c = self.table("customer").select("c_custkey", "c_mktsegment")
        df = self._with_part(li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey))
        return (df.groupBy(_material().alias("material"),
                           F.col("p_name").alias("material_description"),
                           F.col("c_mktsegment").alias("retailer"),
                           F.trunc(_sd(), "week").alias("week_start"))
                  .agg(F.sum(_qty()).cast("bigint").alias("units_sold"),
                       F.sum(F.col("l_linenumber")).cast("bigint").alias("units_on_hand")))

    @role
    def forecast(self) -> DataFrame:
        df = self._with_part(self._line_customer())
        sd = _sd()
        dem = F.add_months(sd, F.col("l_linenumber"))
        return df.select(
            _file_date().alias("file_date"),
            dem.alias("demand_date"),
            _module().alias("module"),
            F.col("c_mktsegment").alias("forecast_group"),
            _sales_org().alias("sales_org"),
            F.when(F.col("l_discount") < 0.09, F.lit(1)).otherwise(F.lit(0)).alias("current_flag"),
            F.col("n_name").alias("region"),
            F.year(dem).alias("calendar_year"),
            F.month(dem).alias("calendar_month"),
            _half(dem).alias("calendar_season"),
            _material().alias("material"),
            F.col("p_type").alias("category"),
            _qty().alias("quantity"),
        )

    @role
    def forecast_history(self) -> DataFrame:
        return self.forecast.withColumnRenamed("forecast_group", "sales_group")

    @role
    def selected_snapshots(self) -> DataFrame:
        """The last file of each month, module and group, from the few columns that name them."""
        o = self.table("orders").select("o_orderkey", "o_custkey")
        c = self.table("customer").select("c_custkey", "c_mktsegment")
        files = self.table("lineitem").select("l_orderkey", _file_date().alias("file_date"), _module().alias("module"))
        named = (files.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
                      .select("file_date", "module", F.col("c_mktsegment").alias("sales_group")))
        return (named.groupBy(F.trunc("file_date", "MM").alias("month"), "module", "sales_group")
                     .agg(F.max("file_date").alias("file_date")).select("file_date", "module", "sales_group"))

    @role
    def line_list(self) -> DataFrame:
        df = self._with_part(self.table("lineitem"))
        sd = _sd()
        msrp = F.col("p_retailprice").cast(MONEY)
        return (df.select(
                      _material().alias("material"),
                      F.concat(F.when(F.month(sd) <= 6, F.lit("Spring ")).otherwise(F.lit("Fall ")),
                               F.year(sd).cast("string")).alias("season"),
                      F.when(F.col("l_returnflag") == "A", F.lit("INL"))
                       .when(F.col("l_returnflag") == "N", F.lit("SMU"))
                       .when(F.col("l_returnflag") == "R", F.lit("UTY")).alias("inl_or_smu"),
                      F.when(F.col("l_suppkey") % 4 == 1, F.lit(""))
                       .when(F.col("l_suppkey") % 4 == 2, F.lit("US"))
                       .when(F.col("l_suppkey") % 4 == 3, F.lit("EMEA")).alias("smu_intent"),
                      F.col("p_brand").alias("model"),
                      _gender().alias("gender"),
                      msrp.alias("msrp"),
                      (msrp * F.lit(0.5)).cast(MONEY).alias("whsl"))
                  .distinct())

    @role
    def style_master(self) -> DataFrame:
        division = F.when(F.col("p_size") <= 25, F.lit("D1")).otherwise(F.lit("D2"))
        return self.table("part").select(
            F.col("p_partkey").cast("string").alias("material"),
            F.col("p_name").alias("material_description"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("model"),
            _gender().alias("gender"),
            division.alias("division"),
            division.alias("playbook_division"),
            F.col("p_retailprice").cast(MONEY).alias("price"),
        )

    @role
    def accounts(self) -> DataFrame:
        """The accounts that sales and forecasts are grouped by."""
        return self.table("customer").select(F.col("c_mktsegment").alias("forecast_group")).distinct()

    @role
    def material(self) -> DataFrame:
        return self.style_master.select("material", "material_description")

    @role
    def calendar(self) -> DataFrame:
        """One row per date from the first to the last shipment."""
        ends = self.table("lineitem").agg(F.min(_sd()).alias("first"), F.max(_sd()).alias("last"))
        days = ends.select(F.explode(F.sequence("first", "last")).alias("the_date"))
        return days.select("the_date", _half(F.col("the_date")).alias("season_name"))

    @role
    def upc_bridge(self) -> DataFrame:
        return self._by_upc({"material": _material()})

    @role
    def forecast_sheet(self) -> DataFrame:
        """Wide monthly sheet: an unused leading column, two id columns, the UPC, April..October.

        A month is half the units shipped in it, so cells hold fractions; months without any are NULL.
        """
        months = {f"m{m:02d}": F.when(F.col("month") == m, F.col("quantity")) for m in range(4, 11)}
        wide = self._by_upc({"supplier": F.col("l_suppkey")}, {"month": F.month(_sd()), "quantity": _qty()}, months)
        return wide.select(
            F.col("upc").alias("sheet_line"),
            F.concat(F.lit("A"), F.col("upc")).alias("asin"),
            F.concat(F.lit("V"), F.col("supplier").cast("string")).alias("vendor_code"),
            "upc", *[(F.lit(0.5) * F.col(m)).alias(m) for m in months])
