"""Where queries and their SQL are kept: name -> function(spark, sf_dir), name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that gives the same rows where there is one."""

    def keep(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep
