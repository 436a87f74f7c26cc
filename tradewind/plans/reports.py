"""End-to-end report plans.

Each function takes a :class:`~tradewind.sources.Warehouse` and :class:`Params` and returns one lazy
DataFrame: the whole report is a single logical plan, so Catalyst prunes columns and pushes filters
across what were separate materialised stages in the original batch scripts.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame

from ..operators import accounts, buckets, forecast, merge, product, sellthrough, sheet
from ..functions import AsOf, month_window_dates
from ..session import TableStore, shared_dir
from ..sources import (Warehouse, read_sheet, select_positions, sheet_to_json_arrays, sheet_to_json_rows, shred_json_arrays,
                       shred_json_rows, typed_sheet, write_report)
from .params import Params
from .present import respelled


# -- lead-time forecast vs actual ------------------------------------------------------------------

def lead_forecast(wh: Warehouse, p: Params) -> DataFrame:
    as_of = AsOf.of(p.as_of)
    snapshots = wh.snapshots_between(p.lead_date_from, as_of.date)
    return forecast.lead_forecast(wh.between("forecast_history", "file_date", p.lead_date_from, as_of.date), snapshots, wh.material, as_of,
                                  date_from=p.lead_date_from, categories=p.categories, sales_org=p.sales_org,
                                  sales_group=p.lead_sales_group, module=p.lead_module, lead=p.lead_months)


def monthly_actuals(wh: Warehouse, p: Params) -> DataFrame:
    return forecast.monthly_actuals(wh.sales_fact, p.as_of, date_from=p.actuals_from, categories=p.categories,
                                    excluded_order_types=p.excluded_order_types, sales_org=p.sales_org,
                                    account=p.actuals_account)


def forecast_vs_actual(wh: Warehouse, p: Params) -> DataFrame:
    actuals = forecast.monthly_actuals(wh.sales_fact, p.as_of, date_from=p.lead_actuals_from,
                                       categories=p.categories, excluded_order_types=p.excluded_order_types,
                                       sales_org=p.sales_org, account=p.lead_account)
    return forecast.forecast_vs_actual(lead_forecast(wh, p), actuals, wh.style_master, min_year=p.min_year)


# -- marketing dashboard ---------------------------------------------------------------------------

def bulk_order_keys(wh: Warehouse, p: Params) -> DataFrame:
    return buckets.bulk_order_keys(wh.sales_orders, account_patterns=p.account_patterns,
                                   bulk_order_types=p.bulk_order_types,
                                   excluded_order_types=p.excluded_order_types, sales_org=p.sales_org)


def bulk_buckets(wh: Warehouse, p: Params) -> DataFrame:
    first, last = month_window_dates(AsOf.of(p.as_of), 0, 1)
    return buckets.bulk_buckets(wh.between("open_orders", "cancel_dt", first, last), bulk_order_keys(wh, p), p.as_of, plant=p.plant)


def bulk_max_by_material(wh: Warehouse, p: Params) -> DataFrame:
    return buckets.bulk_max_by_material(bulk_buckets(wh, p))


def inbound_buckets(wh: Warehouse, p: Params) -> DataFrame:
    return buckets.inbound_buckets(wh.available_to_sell, p.as_of, plant=p.plant, weeks=p.inbound_weeks)


def sell_in_trailing(wh: Warehouse, p: Params) -> DataFrame:
    return buckets.sell_in_trailing(wh.sales_fact, p.as_of, account_patterns=p.account_patterns,
                                    excluded_order_types=p.excluded_order_types, sales_org=p.sales_org,
                                    days=p.sell_in_days)


def open_order_buckets(wh: Warehouse, p: Params) -> DataFrame:
    return buckets.open_order_buckets(wh.sales_fact, p.as_of, account_patterns=p.account_patterns,
                                      excluded_order_types=p.excluded_order_types,
                                      bulk_order_types=p.open_bulk_order_types, open_status=p.open_status,
                                      sales_org=p.sales_org)


def _weeks(wh: Warehouse, p: Params) -> DataFrame:
    return wh.between("sell_through", "week_start", AsOf.of(p.as_of).first_date_after_days_ago(p.sell_through_days))


def sell_through(wh: Warehouse, p: Params) -> DataFrame:
    return sellthrough.sell_through(_weeks(wh, p), p.as_of, retailer_patterns=p.account_patterns, days=p.sell_through_days)


def latest_week_onhand(wh: Warehouse, p: Params) -> DataFrame:
    window = sellthrough.sell_through_window(_weeks(wh, p), p.as_of, retailer_patterns=p.account_patterns,
                                             days=p.sell_through_days)
    return sellthrough.latest_week_onhand(window)


def snapshot_dedup(wh: Warehouse, p: Params) -> DataFrame:
    return forecast.snapshot_dedup(wh.forecast, account_patterns=p.account_patterns, module=p.forecast_module)


def snapshot_dedup_merged(wh: Warehouse, p: Params) -> DataFrame:
    """The state of the files before the report month, merged with that of the later files."""
    return forecast.merge_states([
        forecast.snapshot_dedup(files, account_patterns=p.account_patterns, module=p.forecast_module) for files in _two_parts(wh, p)], "snapshot_date")


def _two_parts(wh: Warehouse, p: Params) -> list[DataFrame]:
    first = AsOf.of(p.as_of).month_start
    return [wh.between("forecast", "file_date", None, first - _dt.timedelta(days=1)), wh.between("forecast", "file_date", first)]


def forecast_month_pivot(wh: Warehouse, p: Params) -> DataFrame:
    return forecast.forecast_month_pivot(snapshot_dedup(wh, p), p.as_of)


def anchored_outer_merge(wh: Warehouse, p: Params, with_copies: bool = True) -> DataFrame:
    # every branch is computed once: they are united, tagged, and meet in one shuffle by material
    sales = buckets.sales_branches(wh.sales_fact, p.as_of, account_patterns=p.account_patterns,
                                   excluded_order_types=p.excluded_order_types, bulk_order_types=p.open_bulk_order_types,
                                   open_status=p.open_status, sales_org=p.sales_org, days=p.sell_in_days)
    bulk, ats, sales, thru, fc = wh.keep(bulk_max_by_material(wh, p), inbound_buckets(wh, p), sales,
                                         sell_through(wh, p), forecast_month_pivot(wh, p))
    return merge.marketing_merge(bulk, ats, sales, thru, fc, wh.style_master, weeks=p.inbound_weeks, with_copies=with_copies)


def marketing_dashboard(wh: Warehouse, p: Params) -> DataFrame:
    # the final MAX ignores multiplicity, so the merge is not grouped into (row, copies)
    return merge.marketing_dashboard(anchored_outer_merge(wh, p, with_copies=False), weeks=p.inbound_weeks)


# -- net revenue by account ------------------------------------------------------------------------

def account_group_sales(wh: Warehouse, p: Params) -> DataFrame:
    return accounts.account_groups(wh.sales_fact, p.sales_rules)


def account_group_forecast(wh: Warehouse, p: Params) -> DataFrame:
    return accounts.account_groups(wh.forecast, p.forecast_rules)


def current_forecast(wh: Warehouse, p: Params) -> DataFrame:
    year = AsOf.of(p.as_of).year_days_ago(p.history_days)
    return forecast.current_forecast(wh.between("forecast", "demand_date", _dt.date(year, 1, 1)), p.as_of, rules=p.forecast_rules, sales_org=p.sales_org,
                                     module=p.forecast_module, region_override=p.region_override,
                                     history_days=p.history_days, material_prefix=p.material_prefix)


def current_forecast_merged(wh: Warehouse, p: Params) -> DataFrame:
    """The current forecast from two states: the files before the report month, and the later ones."""
    states = [forecast.current_state(files, rules=p.forecast_rules, sales_org=p.sales_org, module=p.forecast_module,
                                     material_prefix=p.material_prefix) for files in _two_parts(wh, p)]
    return forecast.current_forecast_of(forecast.merge_states(states, "recent_date"), p.as_of, region_override=p.region_override,
                                        history_days=p.history_days, material_prefix=p.material_prefix)


def sales_with_season(wh: Warehouse, p: Params) -> DataFrame:
    first = AsOf.of(p.as_of).first_date_after_days_ago(p.history_days)
    sales = wh.between("sales_fact", "request_ship_dt", first)
    return accounts.sales_with_season(sales, wh.calendar_of("sales_fact", "request_ship_dt", first), p.as_of, rules=p.sales_rules,
                                      excluded_order_types=p.account_excluded_order_types,
                                      excluded_groups=p.excluded_groups, sales_org=p.sales_org,
                                      history_days=p.history_days, material_prefix=p.material_prefix)


def order_type_pivot(wh: Warehouse, p: Params) -> DataFrame:
    return accounts.order_type_pivot(sales_with_season(wh, p), order_types=p.order_types)


def _lines(wh: Warehouse, p: Params) -> DataFrame:
    """The line list of the prefix's materials, summarised once for spans, numbers and prices."""
    return product.line_summary(wh.line_list, p.material_prefix)


def season_span(wh: Warehouse, p: Params) -> DataFrame:
    return product.span_of(_lines(wh, p))


def account_month_fact(wh: Warehouse, p: Params) -> DataFrame:
    return accounts.account_month_fact(current_forecast(wh, p), order_type_pivot(wh, p), season_span(wh, p),
                                       wh.style_master, footbed_patterns=p.footbed_patterns,
                                       socks_patterns=p.socks_patterns, type_names=p.type_names,
                                       material_prefix=p.material_prefix)


def season_number_account(wh: Warehouse, p: Params) -> DataFrame:
    return product.numbers_of(_lines(wh, p), detail=())


def lifecycle_class_account(wh: Warehouse, p: Params, fact: DataFrame | None = None,
                            distinct_rows: bool = False) -> DataFrame:
    fact = account_month_fact(wh, p) if fact is None else fact
    return accounts.account_classification(fact, season_number_account(wh, p),
                                           accessory_patterns=p.description_accessory_patterns,
                                           distinct_rows=distinct_rows, domestic_intents=p.domestic_intents)


def season_prices(wh: Warehouse, p: Params) -> DataFrame:
    return product.prices_of(product.line_summary(wh.line_list))


def price_attach(wh: Warehouse, p: Params, fact: DataFrame | None = None) -> DataFrame:
    fact = account_month_fact(wh, p) if fact is None else fact
    return accounts.price_attach(fact, product.prices_of(_lines(wh, p)), p.material_prefix)


def _shared_fact(wh: Warehouse, p: Params, fact: DataFrame | None) -> DataFrame:
    """The account-month fact is read three times downstream; stored once where a folder is named."""
    return wh.keep(account_month_fact(wh, p))[0] if fact is None else fact


def account_final(wh: Warehouse, p: Params, fact: DataFrame | None = None) -> DataFrame:
    fact = _shared_fact(wh, p, fact)
    classes = lifecycle_class_account(wh, p, fact=fact, distinct_rows=True)
    return accounts.account_final(price_attach(wh, p, fact=fact), classes, type_names=p.type_names)


def projected_sales(wh: Warehouse, p: Params, fact: DataFrame | None = None) -> DataFrame:
    return accounts.projected_sales(account_final(wh, p, fact=_shared_fact(wh, p, fact)), p.as_of, type_names=p.type_names)


def net_revenue_by_account(wh: Warehouse, p: Params, fact: DataFrame | None = None) -> DataFrame:
    return accounts.net_revenue_by_account(projected_sales(wh, p, fact=_shared_fact(wh, p, fact)), wh.style_master,
                                           type_names=p.type_names, material_prefix=p.material_prefix)


# -- product classification ------------------------------------------------------------------------

def season_number(wh: Warehouse, p: Params) -> DataFrame:
    return product.numbers_of(_lines(wh, p))


def lifecycle_class(wh: Warehouse, p: Params) -> DataFrame:
    return product.lifecycle_class(season_number(wh, p), season_span(wh, p),
                                   accessory_patterns=p.model_accessory_patterns)


def exclusivity_product(wh: Warehouse, p: Params) -> DataFrame:
    return product.exclusivity_product(season_number(wh, p), p.domestic_intents)


def exclusivity_account(wh: Warehouse, p: Params) -> DataFrame:
    return product.exclusivity_account(season_number(wh, p), p.domestic_intents)


def product_classification(wh: Warehouse, p: Params) -> DataFrame:
    return product.product_classification(lifecycle_class(wh, p), wh.style_master, p.domestic_intents)


# -- sheet roll-up ---------------------------------------------------------------------------------

def sheet_project(wh: Warehouse, p: Params) -> DataFrame:
    positioned = select_positions(wh.forecast_sheet, p.sheet_positions)
    return typed_sheet(positioned, "upc", p.sheet_months, id_type="string")


def sheet_json_roundtrip(wh: Warehouse, p: Params) -> DataFrame:
    positioned = select_positions(wh.forecast_sheet, p.sheet_positions)
    return shred_json_rows(sheet_to_json_rows(positioned, p.sheet_months), "upc", p.sheet_months, id_type="string")


def sheet_json_array(wh: Warehouse, p: Params) -> DataFrame:
    positioned = select_positions(wh.forecast_sheet, p.sheet_positions)
    return shred_json_arrays(sheet_to_json_arrays(positioned, p.sheet_months), "upc", p.sheet_months, id_type="string")


def sheet_file(wh: Warehouse, p: Params) -> DataFrame:
    """The sheet exported as CSV to the shared folder, read back with its schema and typed."""
    sheet_ = wh.forecast_sheet
    path = f"{TableStore(wh.spark, shared_dir(wh.spark), mounted=True).delete_on_exit().base}/sheet"
    write_report(sheet_, path, fmt="csv")
    back = read_sheet(wh.spark, path, sheet_.schema)
    return typed_sheet(select_positions(back, p.sheet_positions), "upc", p.sheet_months, id_type="string")


def order_type_pivot_any_case(wh: Warehouse, p: Params) -> DataFrame:
    """Order types over codes in mixed case: equal whatever their case."""
    return order_type_pivot(wh.mixed_case(), p.folded())


def order_type_pivot_spelled(wh: Warehouse, p: Params) -> DataFrame:
    """The same groups under the spelling of the source."""
    folded = wh.mixed_case()
    targets = [target for _, _, target in p.sales_rules]
    return respelled(order_type_pivot(folded, p.folded()), {
        "season_name": folded.spellings("calendar", "season_name"), "forecast_group": folded.spellings("accounts", "forecast_group", targets),
        "material_description": folded.spellings("style_master", "material_description"), "category": folded.spellings("style_master", "category")})


def inline_status(wh: Warehouse, p: Params) -> DataFrame:
    return sheet.inline_status(wh.material, wh.of_season(p.inline_season), p.inline_season)


def sheet_rollup(wh: Warehouse, p: Params) -> DataFrame:
    return sheet.sheet_rollup(sheet_project(wh, p), wh.upc_bridge, wh.material, wh.of_season(p.inline_season),
                              months=p.sheet_months, season=p.inline_season)


REPORTS = {
    "lead_forecast": lead_forecast,
    "monthly_actuals": monthly_actuals,
    "forecast_vs_actual": forecast_vs_actual,
    "bulk_order_keys": bulk_order_keys,
    "bulk_buckets": bulk_buckets,
    "bulk_max_by_material": bulk_max_by_material,
    "inbound_buckets": inbound_buckets,
    "sell_in_trailing": sell_in_trailing,
    "open_order_buckets": open_order_buckets,
    "sell_through": sell_through,
    "latest_week_onhand": latest_week_onhand,
    "snapshot_dedup": snapshot_dedup,
    "snapshot_dedup_merged": snapshot_dedup_merged,
    "forecast_month_pivot": forecast_month_pivot,
    "anchored_outer_merge": anchored_outer_merge,
    "marketing_dashboard": marketing_dashboard,
    "account_group_sales": account_group_sales,
    "account_group_forecast": account_group_forecast,
    "current_forecast": current_forecast,
    "current_forecast_merged": current_forecast_merged,
    "sales_with_season": sales_with_season,
    "order_type_pivot": order_type_pivot,
    "season_span": season_span,
    "account_month_fact": account_month_fact,
    "season_number": season_number,
    "lifecycle_class": lifecycle_class,
    "lifecycle_class_account": lifecycle_class_account,
    "exclusivity_product": exclusivity_product,
    "exclusivity_account": exclusivity_account,
    "product_classification": product_classification,
    "season_prices": season_prices,
    "price_attach": price_attach,
    "account_final": account_final,
    "projected_sales": projected_sales,
    "net_revenue_by_account": net_revenue_by_account,
    "inline_status": inline_status,
    "sheet_project": sheet_project,
    "sheet_json_roundtrip": sheet_json_roundtrip,
    "sheet_json_array": sheet_json_array,
    "sheet_file": sheet_file,
    "order_type_pivot_any_case": order_type_pivot_any_case,
    "order_type_pivot_spelled": order_type_pivot_spelled,
    "sheet_rollup": sheet_rollup,
}
