"""Bounds on derived dates, carried to the stored date they come from.

Many dates of the roles are not stored but derived: a cancel date is some days after the ship date, a
season a half-year of it.  A filter on such a date cannot reach the scan by itself, because the scan
knows only the stored date.  A :class:`Derived` says how far the derived date can lie from the stored
one, so that a bound on the first gives a (looser) bound on the second; the exact filter stays where it
is.

How far is either declared with a guard, or measured.  A declared reach comes with the rows it does not
hold for (``beyond``), and those are never left out.  A measured reach is taken from a stored table when
it is written (:func:`measure`), and holds for that copy.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Shift = Callable[[_dt.date], _dt.date]

FIRST, LAST = _dt.date(1, 1, 1), _dt.date(9999, 12, 31)


def _later(d: _dt.date, days: int) -> _dt.date:
    """``days`` after ``d``, within the dates there are."""
    n = d.toordinal() + days
    return FIRST if n < FIRST.toordinal() else LAST if n > LAST.toordinal() else _dt.date.fromordinal(n)


def _month(d: _dt.date, months: int) -> _dt.date:
    """First day of the month ``months`` after the one of ``d``."""
    m = min(max(d.year * 12 + d.month - 1 + months, 12), LAST.year * 12 + 11)
    return _dt.date(m // 12, m % 12 + 1, 1)


@dataclass(frozen=True)
class Derived:
    """A date that follows from the stored date ``source``.

    ``earliest(d)``: no row whose date is ``d`` or later has a smaller source.  ``latest(d)``: no row whose
    date is ``d`` or earlier has a greater one.  Rows for which ``beyond`` holds are exempt from both.
    """

    source: str
    earliest: Shift
    latest: Shift
    beyond: Callable[[], Column] | None = None

    def reaches(self, first: _dt.date | None, last: _dt.date | None) -> Column | None:
        """The condition on the source that follows from ``first <= date <= last`` (None: no bound)."""
        day = F.col(self.source).cast("date")
        parts = []
        if first is not None:
            parts.append(day >= F.lit(self.earliest(first)).cast("date"))
        if last is not None:
            parts.append(day <= F.lit(self.latest(last)).cast("date"))
        if not parts:
            return None
        if self.beyond is not None:
            # bound by bound, so that each side reaches the scan
            parts = [p | self.beyond() for p in parts]
        return parts[0] if len(parts) == 1 else parts[0] & parts[1]


def days_after(source: str, least: int, most: int, beyond: Callable[[], Column] | None = None) -> Derived:
    """A date from ``least`` to ``most`` days after its source."""
    return Derived(source, lambda d: _later(d, -most), lambda d: _later(d, -least), beyond)


def months_after(source: str, least: int, most: int, beyond: Callable[[], Column] | None = None) -> Derived:
    """A date in a month from ``least`` to ``most`` months after its source's month."""
    return Derived(source, lambda d: _month(d, -most), lambda d: _later(_month(d, 1 - least), -1), beyond)


def week_of(source: str) -> Derived:
    """The Monday of the source's week."""
    return Derived(source, lambda d: _later(d, -d.weekday() % 7), lambda d: _later(d, 6 - d.weekday()))


def bounded(df: DataFrame, column: str, derived: Derived | None, first: _dt.date | None, last: _dt.date | None) -> DataFrame:
    """``df`` where ``first <= column <= last``, and where the source reaches that if it stands in ``df``."""
    if derived is not None:
        reach = derived.reaches(first, last)
        df = df if reach is None else df.where(reach)
    if first is not None:
        df = df.where(F.col(column) >= F.lit(first).cast("date"))
    if last is not None:
        df = df.where(F.col(column) <= F.lit(last).cast("date"))
    return df


def measure(df: DataFrame, source: str, columns: list[str]) -> dict[str, tuple[int, int]]:
    """Least and most days from ``source`` to each of ``columns`` over all rows.

    A column is left out where the source is null on a row that has the date, and where no row has both.
    """
    if not columns:
        return {}
    day = F.col(source).cast("date")
    figures = []
    for c in columns:
        days = F.date_diff(F.col(c).cast("date"), day)
        figures += [F.min(days).alias(f"{c}_least"), F.max(days).alias(f"{c}_most"),
                    F.count_if(day.isNull() & F.col(c).isNotNull()).alias(f"{c}_loose")]
    row = df.agg(*figures).first()
    return {c: (row[f"{c}_least"], row[f"{c}_most"]) for c in columns if not row[f"{c}_loose"] and row[f"{c}_least"] is not None}


def small_side(df: DataFrame, most: int) -> DataFrame:
    """``df`` held by value and broadcast if it has at most ``most`` rows, else ``df`` itself.

    At most ``most + 1`` rows come to the driver.  The other side of a join with so few rows is not shuffled.
    """
    rows = df.limit(most + 1).collect()
    return df if len(rows) > most else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
