"""Conditional-aggregate operators: bulk orders, inbound inventory, trailing sell-in, open orders.

The reference computes these as "CASE on a group key THEN SUM(x) ELSE 0" at a fine grain and then
re-sums at a coarser grain.  Because the CASE tests only group keys, the two stages equal a single
``sum(when(cond, x).otherwise(0))`` at the coarse grain: one aggregation, one shuffle of map-side
partial sums.  Date conditions derived from the report clock become date literals that reach the
Parquet scan as pushed filters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (AsOf, MONEY, after_days_ago, between_now_and, like_any, month_diff,
                         month_window, months_from, on_or_before_now)


def _sum_if(cond, value: str, alias: str, type_: str = "bigint"):
    return F.sum(F.when(cond, F.col(value)).otherwise(F.lit(0))).cast(type_).alias(alias)


def bulk_order_keys(sales: DataFrame, *, account_patterns: Sequence[str], bulk_order_types: Sequence[str],
                    excluded_order_types: Sequence[str], sales_org: str = "US") -> DataFrame:
    """Order ids of the marketplace account's bulk orders (one row per sales line; used as a key set)."""
    cond = (like_any("forecast_group", account_patterns) & (F.col("sales_org") == sales_org)
            & ~F.col("order_type").isin(list(excluded_order_types))
            & F.col("order_type").isin(list(bulk_order_types)))
    return sales.where(cond).select("order_id")


BULK_COLUMNS = ("current_month_bulk", "current_month_bulk_landing_next_month", "current_month_total_bulk",
                "next_month_bulk", "next_month_bulk_landing_month_after", "next_month_total_bulk")


def bulk_buckets(open_orders: DataFrame, keys: DataFrame, as_of, *, plant: str,
                 landing_lag_days: int = 7) -> DataFrame:
    """Open bulk quantity per (material, cancel date) split by cancel month and landing month.

    ``m`` = months from the report month to the cancel date (0 or 1 kept); ``n`` = months from the
    cancel date to the scheduled request date plus ``landing_lag_days``.  ``n < 1`` (including
    negative) lands in the cancel month, ``n == 1`` the month after; later landings count only in the
    totals.
    """
    as_of = AsOf.of(as_of)
    cancel = F.col("cancel_dt")
    m = months_from(as_of, cancel)
    n = month_diff(cancel, F.date_add(F.col("sched_req_dt"), landing_lag_days))
    # a semi join only needs each key once: de-duplicate map-side before the key set is shuffled
    lines = (open_orders.join(keys.select("order_id").distinct(), "order_id", "left_semi")
                        .where((F.col("plant") == plant) & (F.col("open_qty") > 0)
                               & month_window(as_of, 0, 1, cancel)))
    c0, c1 = m == 0, m == 1
    return (lines.groupBy("material", cancel.alias("bulk_month"))
                 .agg(_sum_if(c0 & (n < 1), "open_qty", BULK_COLUMNS[0]),
                      _sum_if(c0 & (n == 1), "open_qty", BULK_COLUMNS[1]),
                      _sum_if(c0, "open_qty", BULK_COLUMNS[2]),
                      _sum_if(c1 & (n < 1), "open_qty", BULK_COLUMNS[3]),
                      _sum_if(c1 & (n == 1), "open_qty", BULK_COLUMNS[4]),
                      _sum_if(c1, "open_qty", BULK_COLUMNS[5])))


MAX_BULK_COLUMNS = ("current_bulk", "current_bulk_landing_next_month", "current_bulk_total",
                    "next_bulk", "next_bulk_landing_month_after", "next_bulk_total")


def bulk_max_by_material(buckets: DataFrame, reducer: str = "max") -> DataFrame:
    """One row per material.  The reference reduces the per-cancel-date sums with MAX (two cancel
    dates in one month are not added); ``reducer='sum'`` adds them instead."""
    fn = F.max if reducer == "max" else F.sum
    return buckets.groupBy("material").agg(
        *[fn(src).cast("bigint").alias(dst) for src, dst in zip(BULK_COLUMNS, MAX_BULK_COLUMNS)])


def inbound_columns(weeks: Sequence[int]) -> list[str]:
    return [f"inbound_{w}w" for w in weeks]


def inbound_buckets(ats: DataFrame, as_of, *, plant: str, weeks: Sequence[int] = (1, 2, 4, 8, 16)) -> DataFrame:
    """Available stock now and stock arriving within 1/2/4/8/16 weeks, per material.

    Buckets are cumulative (the 2-week bucket contains the 1-week one) and start at the report clock.
    """
    as_of = AsOf.of(as_of)
    d = F.col("avail_dt")
    aggs = [_sum_if(on_or_before_now(as_of, d), "quantity", "current_inv")]
    aggs += [_sum_if(between_now_and(as_of, 7 * w, d), "quantity", name)
             for w, name in zip(weeks, inbound_columns(weeks))]
    return (ats.where(F.col("plant") == plant)
               .groupBy("material", "category", "material_description")
               .agg(*aggs))


def _account_sales(account_patterns: Sequence[str], excluded_order_types: Sequence[str], sales_org: str):
    return (~F.col("order_type").isin(list(excluded_order_types)) & (F.col("sales_org") == sales_org)
            & like_any("forecast_group", account_patterns))


def _sell_in_rows(as_of, days: int):
    return after_days_ago(AsOf.of(as_of), days, F.col("transaction_dt")) & (F.col("ship_qty") > 0)


def _open_rows(bulk_order_types: Sequence[str], open_status: str):
    return ((F.col("past_original_ship") == 0) & (F.col("order_status") == open_status)
            & ~F.col("order_type").isin(list(bulk_order_types)))


def sell_in_trailing(sales: DataFrame, as_of, *, account_patterns: Sequence[str],
                     excluded_order_types: Sequence[str], sales_org: str = "US", days: int = 29) -> DataFrame:
    """Units and revenue shipped to the account on the last ``days`` calendar dates (no upper bound)."""
    return (sales.where(_account_sales(account_patterns, excluded_order_types, sales_org) & _sell_in_rows(as_of, days))
                 .groupBy("material", "category", "material_description")
                 .agg(F.sum("ship_qty").cast("bigint").alias("t4w_sellin_units"),
                      F.sum("ship_amt").cast(MONEY).alias("t4w_sellin_rev")))


OPEN_COLUMNS = ("current_month_open", "open_1m", "open_2m")


def open_order_buckets(sales: DataFrame, as_of, *, account_patterns: Sequence[str],
                       excluded_order_types: Sequence[str], bulk_order_types: Sequence[str],
                       open_status: str, sales_org: str = "US") -> DataFrame:
    """Quantity still to ship requested this month, next month and the month after, per material.

    It sums ``ship_open_qty``, a measure of its own beside ``open_qty``.  Every material passing the
    filters gets a row, even when all three buckets are 0.
    """
    m = months_from(AsOf.of(as_of), F.col("request_ship_dt"))
    return (sales.where(_account_sales(account_patterns, excluded_order_types, sales_org) & _open_rows(bulk_order_types, open_status))
                 .groupBy("material", "material_description", "category")
                 .agg(*[_sum_if(m == k, "ship_open_qty", name) for k, name in enumerate(OPEN_COLUMNS)]))


def sales_branches(sales: DataFrame, as_of, *, account_patterns: Sequence[str], excluded_order_types: Sequence[str],
                   bulk_order_types: Sequence[str], open_status: str, sales_org: str = "US", days: int = 29) -> DataFrame:
    """:func:`sell_in_trailing` and :func:`open_order_buckets` from one read of the sales.

    ``has_sell_in`` and ``has_open`` tell which of the two has the row.
    """
    sold, opened = _sell_in_rows(as_of, days), _open_rows(bulk_order_types, open_status)
    m = months_from(AsOf.of(as_of), F.col("request_ship_dt"))
    return (sales.where(_account_sales(account_patterns, excluded_order_types, sales_org) & (sold | opened))
                 .groupBy("material", "category", "material_description")
                 .agg(F.max(F.coalesce(sold, F.lit(False))).alias("has_sell_in"), F.max(F.coalesce(opened, F.lit(False))).alias("has_open"),
                      F.sum(F.when(sold, F.col("ship_qty"))).cast("bigint").alias("t4w_sellin_units"),
                      *[_sum_if(opened & (m == k), "ship_open_qty", name) for k, name in enumerate(OPEN_COLUMNS)]))
