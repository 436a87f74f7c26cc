"""Calendar helpers.

Every report is evaluated against an explicit ``as_of`` moment (never the wall clock).  Because the
warehouse clock carries a time of day while the compared columns are dates, the date bounds derived
from it are computed once in Python and enter the plan as date literals: Catalyst folds them and the
Parquet scan receives them as pushed filters.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_datetime(value) -> _dt.datetime:
    if isinstance(value, _dt.datetime):
        return value
    if isinstance(value, _dt.date):
        return _dt.datetime(value.year, value.month, value.day)
    return _dt.datetime.fromisoformat(str(value))


@dataclass(frozen=True)
class AsOf:
    """The report clock: a naive timestamp (time of day matters for date comparisons)."""

    ts: _dt.datetime

    @staticmethod
    def of(value) -> "AsOf":
        return value if isinstance(value, AsOf) else AsOf(_as_datetime(value))

    @property
    def date(self) -> _dt.date:
        return self.ts.date()

    @property
    def at_midnight(self) -> bool:
        return self.ts.time() == _dt.time(0, 0)

    @property
    def month_index(self) -> int:
        return self.ts.year * 12 + self.ts.month

    @property
    def month_start(self) -> _dt.date:
        return _dt.date(self.ts.year, self.ts.month, 1)

    def first_date_from_now(self) -> _dt.date:
        """Smallest date d with ``d (at 00:00) >= as_of``: today only when the clock reads midnight."""
        return self.date if self.at_midnight else self.date + _dt.timedelta(days=1)

    def last_date_within(self, days: int) -> _dt.date:
        """Largest date d with ``d (at 00:00) <= as_of + days``."""
        return self.date + _dt.timedelta(days=days)

    def first_date_after_days_ago(self, days: int) -> _dt.date:
        """Smallest date d with ``d (at 00:00) > as_of - days`` (same for any time of day)."""
        return self.date - _dt.timedelta(days=days - 1)

    def year_days_ago(self, days: int) -> int:
        return (self.ts - _dt.timedelta(days=days)).year


def lit_date(d: _dt.date) -> Column:
    return F.lit(d).cast("date")


def month_index(c: Column) -> Column:
    """Months since year 0 of a date column, so differences count month *boundaries*."""
    return F.year(c) * 12 + F.month(c)


def month_diff(start: Column, end: Column) -> Column:
    """Number of month boundaries crossed from ``start`` to ``end`` (not full months elapsed)."""
    return month_index(end) - month_index(start)


def months_from(as_of: AsOf, c: Column) -> Column:
    """Month-boundary distance from the report month to the month of ``c``."""
    return month_index(c) - F.lit(as_of.month_index)


def month_floor(c: Column) -> Column:
    """First day of the month of ``c`` as a date (``trunc`` keeps DateType, unlike ``date_trunc``)."""
    return F.trunc(c.cast("date"), "MM")


def month_window_dates(as_of: AsOf, first: int, last: int) -> tuple[_dt.date, _dt.date]:
    """First and last date of the months from ``first`` to ``last`` after the report month."""
    return _add_months(as_of.month_start, first), _add_months(as_of.month_start, last + 1) - _dt.timedelta(days=1)


def month_window(as_of: AsOf, first: int, last: int, c: Column) -> Column:
    """``first <= months_from(as_of, c) <= last`` written as a date range so it can be pushed down."""
    lo, hi = month_window_dates(as_of, first, last)
    return (c >= lit_date(lo)) & (c <= lit_date(hi))


def _add_months(d: _dt.date, n: int) -> _dt.date:
    m = d.year * 12 + (d.month - 1) + n
    return _dt.date(m // 12, m % 12 + 1, 1)


def on_or_before_now(as_of: AsOf, c: Column) -> Column:
    """Date column compared ``<= as_of``."""
    return c <= lit_date(as_of.date)


def between_now_and(as_of: AsOf, days: int, c: Column) -> Column:
    """Date column ``BETWEEN as_of AND as_of + days`` with the clock's time of day honoured."""
    return (c >= lit_date(as_of.first_date_from_now())) & (c <= lit_date(as_of.last_date_within(days)))


def after_days_ago(as_of: AsOf, days: int, c: Column) -> Column:
    """Date column ``> as_of - days``: keeps ``days`` calendar dates up to today, and any later date."""
    return c >= lit_date(as_of.first_date_after_days_ago(days))


def date_between(c: Column, lo: _dt.date, as_of: AsOf) -> Column:
    """Date column between a fixed first date and the report clock, both inclusive."""
    return (c >= lit_date(lo)) & (c <= lit_date(as_of.date))
