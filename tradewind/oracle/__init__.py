"""Independent DuckDB SQL for the correctness gate."""

from .queries_sql import OracleSQL, oracle_queries

__all__ = ["OracleSQL", "oracle_queries"]
