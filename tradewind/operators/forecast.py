"""Forecast branch: lead-time forecast, monthly actuals, forecast vs actual, snapshot dedup,
forecast month pivot, current forecast per account.

Multi-stage reference logic is fused wherever the later stage only re-sums over a coarser key and
the earlier stage's conditions are on group keys (sum of sums == sum).  Stages that group by a
*measure* value (value-level dedup) or reduce with MAX after SUM cannot be fused and stay two
aggregations; both use map-side partial aggregation, so a hot key is pre-aggregated before it is
shuffled.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (AsOf, MONEY, apply_rules, date_between, like_any, month_floor,
                         months_from, safe_int, starts_with)
from .joins import outer_join


def lead_forecast(history: DataFrame, snapshots: DataFrame, material: DataFrame, as_of,
                  *, date_from: _dt.date, categories: Sequence[str], sales_org: str = "US",
                  sales_group: str | None = None, module: str = "Demand", lead: int = 6) -> DataFrame:
    """Forecast quantity that each selected snapshot placed ``lead`` months after its own month.

    One row per (snapshot file date, module, forecast month, season, material, description).
    """
    as_of = AsOf.of(as_of)
    snaps = snapshots.where(date_between(F.col("file_date"), date_from, as_of) & (F.col("module") == module))
    if sales_group is not None:
        snaps = snaps.where(F.col("sales_group") == sales_group)
    hist = history.where((F.col("sales_org") == sales_org) & F.col("category").isin(list(categories)))
    names = material.select("material", "material_description").distinct()
    fmonth = month_floor(F.col("demand_date"))
    joined = (hist.join(snaps, ["file_date", "module", "sales_group"])
                  .join(names, "material")
                  .where(fmonth == F.add_months(month_floor(F.col("file_date")), lead)))
    agg = (joined.groupBy(F.col("file_date").alias("snapshot_date"), "module",
                          fmonth.alias("forecast_month_start"), "calendar_season", "material",
                          "material_description")
                 .agg(F.sum("quantity").cast("bigint").alias("forecast")))
    return agg.select("snapshot_date", "module",
                      F.month("forecast_month_start").alias("forecast_month"),
                      F.year("forecast_month_start").alias("forecast_year"),
                      "calendar_season", "material", "material_description", "forecast")


def monthly_actuals(sales: DataFrame, as_of, *, date_from: _dt.date, categories: Sequence[str],
                    excluded_order_types: Sequence[str], sales_org: str = "US",
                    account: str | None = None) -> DataFrame:
    """Shipped units and revenue per (year, month, material, description) since ``date_from``."""
    as_of = AsOf.of(as_of)
    cond = (~F.col("order_type").isin(list(excluded_order_types))
            & (F.col("sales_org") == sales_org)
            & date_between(F.col("transaction_dt"), date_from, as_of)
            & F.col("category").isin(list(categories))
            & (F.col("ship_qty") > 0))
    if account is not None:
        cond = cond & (F.col("forecast_group") == account)
    return (sales.where(cond)
                 .groupBy("transaction_year", "transaction_month", "material", "material_description")
                 .agg(F.sum("ship_qty").cast("bigint").alias("sales"),
                      F.sum("ship_amt").cast(MONEY).alias("revenue")))


def forecast_vs_actual(lead: DataFrame, actuals: DataFrame, style: DataFrame, *, min_year: int) -> DataFrame:
    """Forecast next to actual units per (model, gender, month, year).

    The reference's full outer join keeps only rows with a forecast, so it is a left join from the
    forecast side; its year condition then reduces to the forecast year, which is pushed below the
    forecast aggregation.  Actuals are cut to the same years before the join (they cannot match
    otherwise), shrinking the shuffle.
    """
    f = lead.where(F.col("forecast").isNotNull() & (F.col("forecast_year") >= min_year))
    a = (actuals.where(F.col("transaction_year") >= min_year)
                .select(F.col("material").alias("a_material"),
                        F.col("transaction_month").alias("a_month"),
                        F.col("transaction_year").alias("a_year"),
                        F.col("sales").alias("a_sales")))
    f = f.select("material", F.col("forecast_month").alias("month"),
                 F.col("forecast_year").alias("year"), "forecast")
    level = outer_join(f, a, ["material", "month", "year"], ["a_material", "a_month", "a_year"], how="left")
    level = level.select("material", "month", "year", "forecast",
                         F.coalesce("a_sales", F.lit(0).cast("bigint")).alias("actual_sales"))
    st = style.select("material", "model", "gender")
    return (level.join(st, "material")
                 .groupBy("model", "gender", "month", "year")
                 .agg(F.sum("forecast").cast("bigint").alias("forecast"),
                      F.sum("actual_sales").cast("bigint").alias("actual_sales")))


def snapshot_dedup(forecast: DataFrame, *, account_patterns: Sequence[str],
                   module: str = "SalesForecast") -> DataFrame:
    """Latest snapshot per (submit month, forecast month, season, material, forecast value).

    First the quantity is summed per snapshot and demand date; then equal values inside one
    (submit month, forecast month, season, material) collapse into a single row carrying the
    latest file date - equal quantities are *not* added (value-level dedup).  The result is a state that
    :func:`merge_states` merges with those of other files (by ``snapshot_date``).
    """
    f = forecast.where(like_any("forecast_group", account_patterns) & (F.col("module") == module))
    per_snapshot = (f.groupBy("module", "demand_date", "calendar_season", "material", "file_date")
                     .agg(F.sum("quantity").cast("bigint").alias("forecast")))
    return (per_snapshot
            .groupBy(month_floor(F.col("file_date")).alias("submitted_date"),
                     month_floor(F.col("demand_date")).alias("forecasted_date"),
                     "calendar_season", "material", "forecast")
            .agg(F.max(F.col("file_date").cast("date")).alias("snapshot_date"))
            .select("snapshot_date", "submitted_date", "forecasted_date", "calendar_season",
                    "material", "forecast"))


def forecast_month_pivot(dedup: DataFrame, as_of, months: int = 3) -> DataFrame:
    """Per material: forecast of the current month and the next ``months - 1`` months.

    Per (material, month) the forecasts are summed; the per-material value is the MAX over months
    of "that month's sum if it is the k-th month, else 0" (so a material whose months are all
    negative shows 0).
    """
    as_of = AsOf.of(as_of)
    m = months_from(as_of, F.col("forecasted_date"))
    names = _month_names("forecast", months)
    per_month = (dedup.groupBy("material", "forecasted_date")
                      .agg(F.sum("forecast").alias("_s"))
                      .select("material", *[F.when(m == k, F.col("_s")).otherwise(F.lit(0)).alias(n)
                                            for k, n in enumerate(names)]))
    return per_month.groupBy("material").agg(*[F.max(n).cast("bigint").alias(n) for n in names])


def _month_names(stem: str, months: int) -> list[str]:
    return [f"current_month_{stem}"] + [f"{stem}_{k}m" for k in range(1, months)]


CURRENT_KEYS = ("group_adjusted", "material", "calendar_year", "calendar_season", "calendar_month", "quantity", "demand_date", "region")


def current_state(forecast: DataFrame, *, rules, sales_org: str = "US", module: str = "SalesForecast",
                  material_prefix: str = "1") -> DataFrame:
    """Forecast rows equal in every key *and* quantity as one row with the latest file date (value-level dedup).

    States of different files are merged by :func:`merge_states`: a new file reads only itself.
    """
    f = forecast.where((F.col("module") == module) & (F.col("sales_org") == sales_org) & (F.col("current_flag") == 1)
                       & starts_with("material", material_prefix) & F.col("forecast_group").isNotNull())
    f = f.withColumn("group_adjusted", apply_rules("forecast_group", rules))
    return f.groupBy(*CURRENT_KEYS).agg(F.max("file_date").alias("recent_date"))


def current_forecast_of(state: DataFrame, as_of, *, region_override: tuple[str, str] | None = None, history_days: int = 720,
                        material_prefix: str = "1") -> DataFrame:
    """:func:`current_forecast` from its state."""
    year = AsOf.of(as_of).year_days_ago(history_days)
    group_out = F.col("group_adjusted")
    if region_override is not None:
        group_out = F.when(F.col("region") == region_override[0], F.lit(region_override[1])).otherwise(group_out)
    rows = state.where(F.col("calendar_year") >= year).select(
        "recent_date", group_out.alias("forecast_group"), safe_int("material").alias("material"), "calendar_year", "calendar_season",
        "calendar_month", F.month("demand_date").alias("calendar_month_number"), "quantity")
    out = (rows.groupBy("recent_date", "forecast_group", "material", "calendar_year", "calendar_season",
                        "calendar_month", "calendar_month_number")
               .agg(F.sum("quantity").cast("bigint").alias("quantity")))
    return out.where(F.col("material").isNotNull() & starts_with("material", material_prefix))


def current_forecast(forecast: DataFrame, as_of, *, rules, sales_org: str = "US",
                     module: str = "SalesForecast", region_override: tuple[str, str] | None = None,
                     history_days: int = 720, material_prefix: str = "1") -> DataFrame:
    """Current forecast per (latest file date, account group, material, year, season, month).

    Account groups come from the ordered ``rules``; ``region_override`` = (region, group) forces the
    group for one region.  Rows equal in every key *and* quantity are first collapsed to one row with
    the latest file date (value-level dedup), then quantities are summed.
    """
    state = current_state(forecast, rules=rules, sales_org=sales_org, module=module, material_prefix=material_prefix)
    return current_forecast_of(state, as_of, region_override=region_override, history_days=history_days, material_prefix=material_prefix)


def merge_states(states: Sequence[DataFrame], latest: str) -> DataFrame:
    """One state of several files' states: the latest date of each key (all columns but ``latest``).

    The latest date of a key over all files is the latest of its dates in parts of them, so a state may
    hold any files, in any order, and a file twice.
    """
    keys = [c for c in states[0].columns if c != latest]
    united = reduce(DataFrame.unionByName, states)
    return united.groupBy(*keys).agg(F.max(latest).alias(latest)).select(*states[0].columns)
