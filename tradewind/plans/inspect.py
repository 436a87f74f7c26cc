"""Plan statistics for reports (what ``explain`` shows, counted)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

_OPERATORS = {
    "shuffles": r"\bExchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)",
    "broadcasts": r"\bBroadcastExchange\b",
    "sort_merge_joins": r"\bSortMergeJoin\b",
    "broadcast_hash_joins": r"\bBroadcastHashJoin\b",
    "aggregates": r"\bHashAggregate\b",
    "windows": r"\bWindow \[",
    "scans": r"\bFileScan\b",
}


def plan_stats(df: DataFrame) -> dict[str, int]:
    """Operator counts of the planned physical plan (before adaptive re-planning at run time)."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    return {name: len(re.findall(pattern, initial)) for name, pattern in _OPERATORS.items()}
