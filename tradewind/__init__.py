"""tradewind: sales, open-order, inventory and forecast planning reports as Spark DataFrame jobs.

Layout
------
functions/  column-expression helpers (month arithmetic, clock bounds, text and season rules)
sources/    role views over the input tables, sheet reader / JSON shredder, file sinks
operators/  composable DataFrame -> DataFrame operators (forecast, buckets, merge, accounts, product, sheet)
plans/      parameter sets and end-to-end report plans that wire the operators together
streaming/  (nothing: the reports are batch jobs; see the module docstring)
oracle/     independent DuckDB SQL for the correctness gate
"""

__version__ = "0.1.0"
