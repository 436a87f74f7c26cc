"""Report parameters.

Every literal code the reports filter on (plant, organisation, order types, accounts, categories,
seasons, text patterns) is a parameter.  ``FIXTURE`` holds the values used with the test tables
(FIXTURES.md §3); a production deployment passes its own, all of them: :meth:`Params.from_json` takes no
value from the test tables.
"""

from __future__ import annotations

import dataclasses
import datetime as _dt
from dataclasses import dataclass, field

from ..functions import AsOf


@dataclass(frozen=True)
class Params:
    as_of: AsOf = AsOf.of("2000-06-15 10:00:00")
    sales_org: str = "US"
    # marketplace account (dashboard branches)
    account_patterns: tuple[str, ...] = ("%IL%",)
    plant: str = "P1"
    excluded_order_types: tuple[str, ...] = ("5-LOW",)
    bulk_order_types: tuple[str, ...] = ("3-MEDIUM", "4-NOT SPECIFIED")
    open_bulk_order_types: tuple[str, ...] = ("4-NOT SPECIFIED",)
    open_status: str = "O"
    categories: tuple[str, ...] = ("ECONOMY", "LARGE", "MEDIUM", "PROMO")
    # lead-time forecast vs actual
    lead_months: int = 6
    lead_module: str = "Demand"
    lead_sales_group: str | None = None
    lead_date_from: _dt.date = _dt.date(1995, 1, 1)
    lead_actuals_from: _dt.date = _dt.date(1995, 1, 1)
    lead_account: str | None = None
    min_year: int = 1996
    # monthly actuals on their own
    actuals_account: str | None = "BUILDING"
    actuals_from: _dt.date = _dt.date(1999, 1, 1)
    # dashboard windows
    sell_in_days: int = 29
    sell_through_days: int = 35
    inbound_weeks: tuple[int, ...] = (1, 2, 4, 8, 16)
    forecast_module: str = "SalesForecast"
    # account branch: sales and forecasts name their accounts differently, so each has its own rules
    sales_rules: tuple = (("equals", ("BUILDING", "FURNITURE"), "HOME"), ("contains", ("AUTO",), "AUTO"))
    forecast_rules: tuple = (("equals", ("FURNITURE", "MACHINERY"), "HOME"), ("equals", ("BUILDING",), "BUILDER'S"),
                             ("contains", ("auto",), "AUTO"))
    region_override: tuple[str, str] | None = ("NATION_1", "DIRECT")
    history_days: int = 720
    account_excluded_order_types: tuple[str, ...] = ("5-LOW", "4-NOT SPECIFIED")
    excluded_groups: tuple[str, ...] = ("MACHINERY",)
    order_types: tuple[tuple[str, str], ...] = (("closeout", "1-URGENT"), ("preseason", "2-HIGH"),
                                                ("atonce", "3-MEDIUM"))
    footbed_patterns: tuple[str, ...] = ("% ring%",)
    socks_patterns: tuple[str, ...] = ("%gear%",)
    # product branch
    material_prefix: str = "1"
    domestic_intents: tuple[str, ...] = ("US", "US, Canada", "Canada")
    model_accessory_patterns: tuple[str, ...] = ("%#25%", "%#24%")
    # sheet
    inline_season: str = "Fall 2000"
    sheet_positions: tuple[int, ...] = tuple(range(1, 11))
    sheet_months: tuple[str, ...] = field(default_factory=lambda: tuple(f"m{m:02d}" for m in range(4, 11)))

    @property
    def type_names(self) -> tuple[str, ...]:
        return tuple(name for name, _ in self.order_types)

    def folded(self) -> "Params":
        """The same parameters with every text in lower case, for a Warehouse with ``fold_case``.

        Output names (order-type prefixes, sheet columns) stay as they are.
        """
        def fold(value):
            if isinstance(value, str):
                return value.lower()
            return tuple(map(fold, value)) if isinstance(value, tuple) else value
        names = ("sheet_months",)
        return dataclasses.replace(self, **{f.name: fold(getattr(self, f.name)) for f in dataclasses.fields(self) if f.name not in names})

    def to_json(self) -> dict:
        """The parameters as a JSON object (without the clock); a file to begin with."""
        def plain(value):
            if isinstance(value, _dt.date):
                return value.isoformat()
            return [plain(v) for v in value] if isinstance(value, (tuple, list)) else value
        return {f.name: plain(getattr(self, f.name)) for f in dataclasses.fields(self) if f.name != "as_of"}

    @classmethod
    def from_json(cls, raw: dict, as_of) -> "Params":
        """The parameters of a JSON object that names every field but the clock (null where there is none)."""
        names = {f.name for f in dataclasses.fields(cls)} - {"as_of"}
        unknown, missing = sorted(set(raw) - names), sorted(names - set(raw))
        if unknown or missing:
            raise ValueError("; ".join(([f"unknown parameters: {', '.join(unknown)}"] if unknown else [])
                                       + ([f"missing parameters: {', '.join(missing)}"] if missing else [])))

        def typed(name, value):
            if name in ("lead_date_from", "lead_actuals_from", "actuals_from"):
                return _dt.date.fromisoformat(value)
            return tuple(typed(None, v) for v in value) if isinstance(value, list) else value
        return cls(as_of=AsOf.of(as_of), **{k: typed(k, v) for k, v in raw.items()})

    @property
    def description_accessory_patterns(self) -> tuple[str, ...]:
        return self.footbed_patterns + self.socks_patterns


FIXTURE = Params()
