"""Composable DataFrame -> DataFrame operators, grouped by report branch."""

from . import accounts, buckets, forecast, joins, merge, product, sellthrough, sheet

__all__ = ["accounts", "buckets", "forecast", "joins", "merge", "product", "sellthrough", "sheet"]
