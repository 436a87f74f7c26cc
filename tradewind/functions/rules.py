"""Ordered mapping rules (first match wins) expressed as one ``CASE`` column.

A rule is ``(kind, values, target)``:

* ``("equals", ["A", "B"], "T")`` - the value equals any of the listed codes (case-sensitive),
* ``("contains", ["X"], "T")``    - the value contains any listed text (case-insensitive),

and values that match no rule are kept unchanged.  Applying the rule as a column expression on the
fact table replaces the reference's "distinct map table + join" without changing results (the join
drops NULL groups, so callers filter ``isNotNull`` first) and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, like_any

Rule = tuple[str, Sequence[str], str]


def rule_predicate(c: Column, kind: str, values: Sequence[str]) -> Column:
    if kind == "equals":
        return c.isin(list(values))
    if kind == "contains":
        return like_any(c, [f"%{v}%" for v in values])
    raise ValueError(f"unknown rule kind {kind!r}")


def apply_rules(c, rules: Sequence[Rule]) -> Column:
    c = col(c)
    out = None
    for kind, values, target in rules:
        cond = rule_predicate(c, kind, values)
        out = F.when(cond, F.lit(target)) if out is None else out.when(cond, F.lit(target))
    return c if out is None else out.otherwise(c)
