"""Retailer sell-through: trailing units per material and on-hand units of the latest week."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import AsOf, after_days_ago, like_any
from .joins import rows_at_max


def sell_through_window(weeks: DataFrame, as_of, *, retailer_patterns: Sequence[str], days: int = 35) -> DataFrame:
    """Weekly rows of the matching retailers whose week starts within the last ``days`` dates."""
    as_of = AsOf.of(as_of)
    return weeks.where(like_any("retailer", retailer_patterns)
                       & after_days_ago(as_of, days, F.col("week_start").cast("date")))


def latest_week_onhand(window: DataFrame) -> DataFrame:
    """Rows of the single latest week in the window (latest over *all* materials): a material that
    did not report that week has no on-hand value."""
    return rows_at_max(window, "week_start").select(
        "material", "material_description", "week_start", F.col("units_on_hand").alias("retailer_onhand"))


def sell_through(weeks: DataFrame, as_of, *, retailer_patterns: Sequence[str], days: int = 35) -> DataFrame:
    """Trailing sell-through units and latest-week on-hand per material, as a bag: distinct rows with
    their number of ``copies``.

    Reference semantics: every latest-week row is paired with every latest-week row of the same
    material and with every (material, description) total of that material, so a material with n
    latest-week rows yields n*n rows.  Those pairs are never formed here: equal rows are counted first
    and the product of the counts is the multiplicity of each result row.

    The window is grouped by material once; a group holds one entry per retailer, description and week
    of the window, which its weeks and retailers bound.  The latest week comes from the same grouped
    rows, so the weekly role is computed once.
    """
    window = sell_through_window(weeks, as_of, retailer_patterns=retailer_patterns, days=days)
    entry = F.struct("material_description", "week_start", "units_sold", "units_on_hand")
    by_material = window.groupBy("material").agg(F.collect_list(entry).alias("entries"))
    last = by_material.agg(F.max(F.array_max(F.transform("entries", lambda e: e["week_start"])))).scalar()
    latest = F.filter("entries", lambda e: e["week_start"] == F.col("last_week"))

    def counted(values, name):
        kinds = F.array_distinct(values)
        return F.explode(F.transform(kinds, lambda v: F.struct(
            v.alias(name), F.size(F.filter(values, lambda x: x.eqNullSafe(v))).cast("bigint").alias("n"))))
    named = by_material.withColumn("last_week", last).withColumn("latest", latest)
    # rows without a material pair with nothing; a filter on it would part this plan from the latest week's
    paired = F.when(F.col("material").isNotNull(), F.col("latest"))
    rows = (named.where(F.size("latest") > 0)
                 .select("material", "entries", "latest", counted(F.transform(paired, lambda e: e["material_description"]), "d").alias("row"))
                 .select("material", "entries", "row", counted(F.transform("latest", lambda e: e["units_on_hand"]), "h").alias("onhand"))
                 .select("material", "row", "onhand", F.explode(_totals(F.col("entries"))).alias("t4w_sellthru_units")))
    return (rows.groupBy("material", F.col("row.d").alias("material_description"), "t4w_sellthru_units", F.col("onhand.h").alias("retailer_onhand"))
                .agg(F.sum(F.col("row.n") * F.col("onhand.n")).cast("bigint").alias("copies")))


def _totals(entries):
    """Units of each description over the window (NULL where a description has no units at all)."""
    def total(description):
        own = F.filter(entries, lambda e: e["material_description"].eqNullSafe(description) & e["units_sold"].isNotNull())
        units = F.aggregate(own, F.lit(0).cast("bigint"), lambda acc, e: acc + e["units_sold"])
        return F.when(F.size(own) > 0, units)
    return F.transform(F.array_distinct(F.transform(entries, lambda e: e["material_description"])), total)
