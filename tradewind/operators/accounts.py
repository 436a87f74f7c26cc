"""Account branch: account groups, sales with season, order-type pivot, account-month fact,
season prices, price attach, account classification, projected sales, net revenue by account."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (AsOf, MONEY, after_days_ago, apply_rules, like_any, safe_int,
                         season_half_fall_first, season_year, starts_with, two_digit)
from .joins import outer_join
from .product import DOMESTIC_INTENTS, exclusive_account_expr, lifecycle_expr


def account_groups(df: DataFrame, rules, group_col: str = "forecast_group") -> DataFrame:
    """Distinct (adjusted group, source group) map of a fact table under ordered ``rules``."""
    return df.select(apply_rules(group_col, rules).alias("group_adjusted"), F.col(group_col)).distinct()


def sales_with_season(sales: DataFrame, calendar: DataFrame, as_of, *, rules,
                      excluded_order_types: Sequence[str], excluded_groups: Sequence[str],
                      sales_org: str = "US", history_days: int = 720, material_prefix: str = "1") -> DataFrame:
    """Sales lines of the last ``history_days`` request dates with the season of the transaction date
    and the account group.  The group mapping is a column expression, not a join to a map table; rows
    without a group have none in the map and are dropped."""
    as_of = AsOf.of(as_of)
    s = sales.where(~F.col("order_type").isin(list(excluded_order_types)) & (F.col("sales_org") == sales_org)
                    & F.col("forecast_group").isNotNull() & ~F.col("forecast_group").isin(list(excluded_groups))
                    & after_days_ago(as_of, history_days, F.col("request_ship_dt"))
                    & starts_with("material", material_prefix))
    # a calendar has one row per date, 3.7 million from year 1 to 9999; the fact is not shuffled on dates
    cal = F.broadcast(calendar.select("the_date", "season_name"))
    j = s.join(cal, s["transaction_dt"] == cal["the_date"])
    return j.select("transaction_year", "transaction_month", "season_name",
                    apply_rules("forecast_group", rules).alias("forecast_group"), "region", "material",
                    "material_description", "category", "order_type", "ship_qty", "ship_amt",
                    "open_qty", "open_amt")


PIVOT_MEASURES = (("ship_qty", "sold_quantity", "bigint"), ("ship_amt", "sold_revenue", MONEY))
OPEN_MEASURES = (("open_qty", "open_quantity", "bigint"), ("open_amt", "open_revenue", MONEY))


def pivot_columns(type_names: Sequence[str] = ("closeout", "preseason", "atonce")) -> list[str]:
    out = []
    for measures in (PIVOT_MEASURES, OPEN_MEASURES):
        for t in type_names:
            out += [f"{t}_{name}" for _, name, _ in measures]
    return out


TOTALS = (("ship_qty", "units", "bigint"), ("ship_amt", "rev", MONEY),
          ("open_qty", "open_units", "bigint"), ("open_amt", "open_amt", MONEY))


def order_type_pivot(sws: DataFrame, *, order_types: Sequence[tuple[str, str]]) -> DataFrame:
    """Shipped/open units and revenue per order type as columns, plus totals, per
    (year, month, season, group, material, description, category).  ``order_types`` are
    (output prefix, order type code) pairs."""
    aggs = []
    for measures in (PIVOT_MEASURES, OPEN_MEASURES):
        for prefix, code in order_types:
            for src, name, type_ in measures:
                aggs.append(F.sum(F.when(F.col("order_type") == code, F.col(src)).otherwise(F.lit(0)))
                             .cast(type_).alias(f"{prefix}_{name}"))
    aggs += [F.sum(src).cast(type_).alias(name) for src, name, type_ in TOTALS]
    return (sws.groupBy("transaction_year", "transaction_month", "season_name", "forecast_group", "material",
                        "material_description", "category")
               .agg(*aggs))


FACT_MEASURES = (("so_quantity", "forecasted_quantity", "bigint"), ("units", "sold_quantity", "bigint"),
                 ("rev", "actual_revenue", MONEY), ("open_units", "open_quantity", "bigint"),
                 ("open_amt", "open_revenue", MONEY))


def account_month_fact(sot: DataFrame, pivot: DataFrame, span: DataFrame, style: DataFrame, *,
                       footbed_patterns: Sequence[str], socks_patterns: Sequence[str],
                       type_names: Sequence[str] = ("closeout", "preseason", "atonce"),
                       material_prefix: str = "1") -> DataFrame:
    """Forecast and sales side by side per (group, material, year, month) with span and style.

    Full outer join of forecast and sales on (material, group, year, month); season span and style
    attach on the merged material (their unmatched rows are removed by the year condition, so those
    are left joins).  Category is overridden by description text; month is two-digit text; missing
    measures are 0.  Distinct rows.
    """
    pcols = pivot_columns(type_names)
    # Only these forecast columns reach the (distinct) output, so rows differing in the snapshot date
    # alone are merged before the join instead of multiplying it.
    so = sot.select(F.col("forecast_group").alias("so_group"), F.col("material").alias("so_material"),
                    F.col("calendar_year").alias("so_year"), F.col("calendar_season").alias("so_season"),
                    F.col("calendar_month_number").alias("so_month"),
                    F.col("quantity").alias("so_quantity")).distinct()
    sa = pivot.select(F.col("forecast_group").alias("sa_group"), safe_int("material").alias("sa_material"),
                      F.col("material_description").alias("sa_description"),
                      F.col("category").alias("sa_category"), F.col("transaction_year").alias("sa_year"),
                      F.col("transaction_month").alias("sa_month"), F.col("season_name").alias("sa_season"),
                      "units", "rev", "open_units", "open_amt", *pcols)
    both = outer_join(so, sa, ["so_material", "so_group", "so_year", "so_month"],
                      ["sa_material", "sa_group", "sa_year", "sa_month"], how="full")
    both = both.where(F.col("so_year").isNotNull() | F.col("sa_year").isNotNull())
    both = both.withColumn("_k", F.coalesce("so_material", "sa_material"))
    se = span.select(safe_int("material").alias("se_material"), "earliest_year", "latest_year", "total_seasons")
    sm = (style.where(starts_with("material", material_prefix))
               .select(safe_int("material").alias("sm_material"),
                       F.col("material_description").alias("sm_description"),
                       F.col("category").alias("sm_category")))
    j = outer_join(both, se, ["_k"], ["se_material"], how="left")
    j = outer_join(j, sm, ["_k"], ["sm_material"], how="left")
    desc = F.coalesce("sa_description", "sm_description")
    category = (F.when(like_any(desc, footbed_patterns), F.lit("Footbed"))
                 .when(like_any(desc, socks_patterns), F.lit("Socks"))
                 .otherwise(F.coalesce("sa_category", "sm_category")))
    measures = [F.coalesce(F.col(src), F.lit(0).cast(t)).cast(t).alias(dst) for src, dst, t in FACT_MEASURES]
    measures += [F.coalesce(F.col(c), F.lit(0).cast("bigint" if "quantity" in c else MONEY)).alias(c)
                 for c in pcols]
    return j.select(F.coalesce("so_group", "sa_group").alias("forecast_group"),
                    F.coalesce("so_material", "se_material", "sa_material").alias("material"),
                    desc.alias("material_description"), category.alias("category"),
                    F.coalesce("so_year", "sa_year").alias("year"),
                    F.coalesce("so_season", "sa_season").alias("calendar_season"),
                    two_digit(F.coalesce("so_month", "sa_month")).alias("month"),
                    *measures, "earliest_year", "latest_year", "total_seasons").distinct()


def account_classification(fact: DataFrame, numbered: DataFrame, *, accessory_patterns: Sequence[str],
                           distinct_rows: bool = False,
                           domestic_intents: Sequence[str] = DOMESTIC_INTENTS) -> DataFrame:
    """Life-cycle class and exclusivity for each account-month fact row (left join to the numbered
    line list on material, year and season).  With ``distinct_rows`` the fact is first reduced to
    the columns the classification reads, so months and groups do not multiply the work."""
    f = fact.select("material", "material_description", "calendar_season", "year", "earliest_year", "latest_year")
    if distinct_rows:
        f = f.distinct()
    fo = numbered.select(safe_int("material").alias("fo_material"), F.col("year").alias("fo_year"),
                         F.col("calendar_season").alias("fo_season"), "season_number", "smu_intent", "inl_or_smu")
    j = outer_join(f, fo, ["material", "year", "calendar_season"], ["fo_material", "fo_year", "fo_season"],
                   how="left")
    cls = lifecycle_expr(F.col("material_description"), accessory_patterns, F.col("season_number"),
                         F.col("smu_intent"), F.col("year"), F.col("earliest_year"), F.col("latest_year"))
    out = j.select("material", "material_description",
                   F.coalesce("calendar_season", "fo_season").alias("calendar_season"),
                   F.coalesce("year", "fo_year").alias("year"), cls.alias("classification"),
                   exclusive_account_expr(F.col("inl_or_smu"), F.col("smu_intent"), domestic_intents).alias("exclusive"),
                   "smu_intent", "inl_or_smu", "season_number")
    return out


def season_prices(line_list: DataFrame) -> DataFrame:
    """Highest wholesale and retail price per (season, material, gender); the half-year defaults to
    Spring-Summer unless the season label says Fall."""
    g = (line_list.groupBy("season", "material", "gender")
                  .agg(F.max("whsl").alias("whsl"), F.max("msrp").alias("msrp")))
    return g.select(season_half_fall_first("season").alias("calendar_season"),
                    season_year("season").alias("calendar_year"), "material", "gender", "whsl", "msrp")


def price_attach(fact: DataFrame, prices: DataFrame, material_prefix: str = "1") -> DataFrame:
    """Account-month fact rows with every matching price row (one per gender), materials of the prefix."""
    # the fact holds no other material; with the same filter the prices share the line list's shuffle
    pd_ = prices.where(starts_with("material", material_prefix)).select(safe_int("material").alias("pd_material"), F.col("calendar_year").alias("pd_year"),
                        F.col("calendar_season").alias("pd_season"), "whsl", "msrp")
    f = fact.where(F.col("material").isNotNull() & starts_with("material", material_prefix))
    j = outer_join(f, pd_, ["material", "year", "calendar_season"], ["pd_material", "pd_year", "pd_season"],
                   how="left")
    keep = [c for c in fact.columns if c not in ("earliest_year", "latest_year", "total_seasons")]
    return j.select(*keep, "whsl", "msrp", "earliest_year", "latest_year", "total_seasons")


FINAL_MEASURES = ("forecasted_quantity", "sold_quantity", "open_quantity", "actual_revenue", "open_revenue")


def account_final(priced: DataFrame, classes: DataFrame,
                  type_names: Sequence[str] = ("closeout", "preseason", "atonce")) -> DataFrame:
    """Distinct fact rows joined with their (material, season, year) classification.

    The reference joins row-to-row and removes the resulting duplicates with DISTINCT.  Both sides
    are reduced to their distinct projected rows first, so the join never pairs duplicates; pairs of
    distinct rows from each side are already distinct, so no DISTINCT is needed after the join.
    """
    keys = ["material", "calendar_season", "year"]
    left = priced.select("forecast_group", "material", "material_description", "year", "calendar_season",
                         "month", *FINAL_MEASURES, *pivot_columns(type_names), "msrp", "whsl").distinct()
    right = classes.select(*keys, "season_number", "classification", "exclusive").distinct()
    return left.join(right, keys)


def projected_sales(final: DataFrame, as_of,
                    type_names: Sequence[str] = ("closeout", "preseason", "atonce")) -> DataFrame:
    """Sold units for past months, forecast units for the current and later months.

    Grouped by everything except description and season number, *including the measures*, so rows
    differing only there are summed (their projection multiplies).
    """
    as_of = AsOf.of(as_of)
    pcols = pivot_columns(type_names)
    keys = [c for c in final.columns if c not in ("material_description", "season_number")]
    month_start = F.make_date(F.col("year"), F.col("month").cast("int"), F.lit(1))
    past = month_start < F.lit(as_of.month_start).cast("date")
    proj = F.when(past, F.sum("sold_quantity")).otherwise(F.sum("forecasted_quantity"))
    g = final.groupBy(*keys).agg(proj.cast("bigint").alias("projected_sales"))
    return g.select("material", "forecast_group", "classification", "exclusive", "month", "calendar_season",
                    "year", "whsl", "msrp", *FINAL_MEASURES, *pcols, "projected_sales",
                    F.lit(0).alias("discount"))


def net_revenue_by_account(ps: DataFrame, style: DataFrame,
                           type_names: Sequence[str] = ("closeout", "preseason", "atonce"),
                           material_prefix: str = "1") -> DataFrame:
    """Projected sales with style attributes, measures summed per account/material/month; missing
    prices fall back to the style price (retail = 2 x price, wholesale = price)."""
    pcols = pivot_columns(type_names)
    sm = (style.where(starts_with("material", material_prefix))
               .select(safe_int("material").alias("sm_material"), "material_description", "category",
                       "division", "playbook_division", "gender", "price"))
    j = ps.join(sm, ps["material"] == sm["sm_material"])
    sums = [c for c in FINAL_MEASURES if c != "forecasted_quantity"] + pcols
    keys = [c for c in j.columns if c not in (*sums, "discount", "sm_material")]
    aggs = [F.sum(c).cast("bigint" if ("quantity" in c) else MONEY).alias(c) for c in sums]
    g = j.groupBy(*keys).agg(*aggs)
    msrp = F.when(F.col("msrp").isNull(), F.col("price") * 2).otherwise(F.col("msrp")).cast(MONEY)
    whsl = F.when(F.col("whsl").isNull(), F.col("price")).otherwise(F.col("whsl")).cast(MONEY)
    return g.select("material", "material_description", "category", "division", "playbook_division", "gender",
                    "classification", "exclusive", "forecast_group", "month", "calendar_season", "year",
                    "forecasted_quantity", *sums, "projected_sales", msrp.alias("msrp"), whsl.alias("whsl"))
