"""Where a module's queries and their DuckDB counterparts are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.oracle[name] = sql
            return query

        return add
