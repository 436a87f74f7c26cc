"""Rejected values: texts that their typed reading cannot hold.

The reports read some texts as numbers (materials, the year of a season) and shred JSON into typed
columns.  What does not fit becomes NULL there, and its row may drop out of a join.  Here such rows are
made visible, without a pass of their own over good data: counted while they pass
(:func:`observed`), written to a table with their reason (:func:`rejected`), or made an error
(:func:`insist`).  ``audit_roles`` does the first two for every role of a warehouse.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import season_year
from .sheet import publish_report

SCHEMA = "reason string, column string, value string, row string"


@dataclass(frozen=True)
class Rule:
    """``lost`` tells where ``column`` has a value that its typed reading loses."""

    column: str
    reason: str
    lost: Callable[[Column], Column]

    @property
    def name(self) -> str:
        return f"{self.column}: {self.reason}"

    def bad(self) -> Column:
        return F.coalesce(self.lost(F.col(f"`{self.column}`")), F.lit(False))


def whole_number(column: str) -> Rule:
    """Text that is no whole number of a bigint (NULL is none, and fits)."""
    return Rule(column, "no whole number", lambda c: c.isNotNull() & c.cast("string").try_cast("bigint").isNull())


def season_label(column: str, undated: Sequence[str] = ()) -> Rule:
    """A season that does not end in a year, other than the ``undated`` ones (whatever their case)."""
    allowed = [u.lower() for u in undated]
    return Rule(column, "no year", lambda c: c.isNotNull() & season_year(c).isNull() & ~F.lower(F.trim(c)).isin(allowed))


def json_object(column: str, fields: str) -> Rule:
    """Text that is no JSON object, or holds a field that does not fit its type."""
    def lost(c: Column) -> Column:
        typed = F.from_json(c, f"{fields}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
        return c.isNotNull() & (typed.isNull() | typed["_corrupt"].isNotNull())
    return Rule(column, "no such JSON object", lost)


#: what the reports read as numbers, role by role
ROLE_RULES: dict[str, tuple[Rule, ...]] = {
    "sales_fact": (whole_number("material"),),
    "forecast": (whole_number("material"),),
    "line_list": (whole_number("material"), season_label("season", ("carryover",))),
    "style_master": (whole_number("material"),),
    "upc_bridge": (whole_number("material"),),
}


def observed(df: DataFrame, rules: Iterable[Rule]) -> tuple[DataFrame, Observation]:
    """``df``, and the observation that holds its ``rows`` and the lost values of every rule when it has been
    read once (``observation.get``)."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(r.bad()).alias(r.name) for r in rules]), seen


def rejected(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """(reason, column, value, row): one row for each lost value, with its whole row as JSON."""
    found = F.array(*[F.when(r.bad(), F.struct(F.lit(r.reason).alias("reason"), F.lit(r.column).alias("column"),
                                               F.col(f"`{r.column}`").cast("string").alias("value"))) for r in rules])
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    each = df.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("lost"), row.alias("row"))
    return each.select("lost.reason", "lost.column", "lost.value", "row")


def accepted(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows that lose nothing."""
    return df.where(~reduce(or_, [r.bad() for r in rules])) if rules else df


def insist(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``df``; the first lost value that is read fails the job and is named."""
    def check(r: Rule) -> Column:
        text = F.concat(F.lit(f"{r.name}: "), F.col(f"`{r.column}`").cast("string"))
        return F.when(r.bad(), F.raise_error(text).cast("boolean")).otherwise(F.lit(True))
    return reduce(lambda out, r: out.where(check(r)), rules, df)


def audit_roles(wh, path: str, rules: dict[str, tuple[Rule, ...]] | None = None) -> dict[str, dict[str, int]]:
    """Publish the rejected values of each role below ``path/<role>``; gives the rows read and the lost
    values of each rule.  A role is read once."""
    out = {}
    for role, own in (ROLE_RULES if rules is None else rules).items():
        df, seen = observed(getattr(wh, role), own)
        publish_report(rejected(df, own), f"{path.rstrip('/')}/{role}")
        out[role] = dict(seen.get)
    return out
