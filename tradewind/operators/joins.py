"""Join building blocks.

Broadcast decisions are left to adaptive query execution: with ``spark.sql.adaptive.enabled`` the
planner measures each shuffled side at run time and only converts to a broadcast hash join when the
measured size is under ``spark.sql.autoBroadcastJoinThreshold``, so nothing whose size grows with the
data is broadcast blindly.  Two broadcasts are explicit, both of a fixed bound: a one-row global aggregate
(``rows_at_max``) and the calendar of ``accounts.sales_with_season`` (a row per date).  ``sources.derived.small_side``
counts a side first and holds it by value only below a bound.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all_not_null(df: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(and_, [df[k].isNotNull() for k in keys])


#: groups of NULL-key rows for each shuffle partition
NULL_GROUPS = 4


def null_groups(df: DataFrame) -> int:
    """Groups that NULL-key rows are dealt over: several for every shuffle partition of the session."""
    return NULL_GROUPS * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _null_salt(df: DataFrame, keys: Sequence[str], name: str, groups: int) -> DataFrame:
    """Extra join key: for rows with complete keys a hash of the key values (equal on both sides for
    matching rows), for rows with a NULL key a hash of the whole row, in a separate range.

    The complete-key value depends on the data, so Catalyst cannot fold it into a constant and drop
    it from the join keys (a literal 0 would become a post-join filter and the NULL-key rows would
    share one partition again).  Equal values hash alike only with equal types, which
    :func:`outer_join` checks.
    """
    key_hash = F.pmod(F.xxhash64(*[df[k] for k in keys]), F.lit(groups))
    spread = F.pmod(F.xxhash64(*[df[c] for c in df.columns]), F.lit(groups)) + groups
    return df.withColumn(name, F.when(_all_not_null(df, keys), key_hash).otherwise(spread).cast("int"))


def outer_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str],
               right_keys: Sequence[str], how: str = "full", divide: bool = False) -> DataFrame:
    """Equi outer join (``full`` or ``left``) that does not pile NULL-key rows into one task.

    A row with a NULL join key never matches, yet a sort-merge join hashes all such rows to the same
    partition.  In a full join each side gets one more join key (see ``_null_salt``): matching rows carry
    equal values, so complete-key rows join exactly as before, while NULL-key rows still match nothing
    (NULL = x is never true) but are spread over ``null_groups``.  A left join needs no such key:
    adaptive execution splits a large left partition by itself, and the plain keys let joins on the same
    keys share one partitioning.  The two sides must have disjoint column names and keys of equal types.

    A full join is computed by one task for each key, which suits sides that were grouped by the key before.
    With ``divide`` it is the left join and, beside it, the right rows without a partner; adaptive execution
    divides a hot key in both (and the sides are computed twice).
    """
    if how not in ("full", "left"):
        raise ValueError("how must be 'full' or 'left'")
    ltypes = [left.schema[k].dataType for k in left_keys]
    rtypes = [right.schema[k].dataType for k in right_keys]
    if ltypes != rtypes:
        raise TypeError(f"join keys must have equal types, got {ltypes} and {rtypes}")
    if how == "left":
        return left.join(right, reduce(and_, [left[a] == right[b] for a, b in zip(left_keys, right_keys)]), how)
    if divide:
        known = left.select(*[left[k].alias(f"_known_{i}") for i, k in enumerate(left_keys)]).distinct()
        lone = right.join(known, reduce(and_, [right[b] == known[f"_known_{i}"] for i, b in enumerate(right_keys)]), "left_anti")
        lone = lone.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema], *right.columns)
        return outer_join(left, right, left_keys, right_keys, "left").unionAll(lone)
    groups = null_groups(left)
    lhs = _null_salt(left, left_keys, "_lnull", groups)
    rhs = _null_salt(right, right_keys, "_rnull", groups)
    cond = reduce(and_, [lhs[a] == rhs[b] for a, b in zip(left_keys, right_keys)]
                  + [lhs["_lnull"] == rhs["_rnull"]])
    return lhs.join(rhs, cond, how).drop("_lnull", "_rnull")


def rows_at_max(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` equals its maximum over the whole input (uncorrelated scalar subquery).

    The maximum is a global aggregate (partial per task, one final row); the rows are kept by an
    equi-join against that one-row table, which is broadcast because its size never grows.
    """
    top = df.agg(F.max(column).alias("_top"))
    return df.join(F.broadcast(top), df[column] == top["_top"]).drop("_top")
