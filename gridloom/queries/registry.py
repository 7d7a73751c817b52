"""How a query is registered: a function of (spark, sf_dir), and the SQL that gives the same rows, if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is there already")
        self.queries[name] = query
        if sql:
            self.sql[name] = sql

    def __call__(self, name: str, sql: str | None = None):
        def put(query: Query) -> Query:
            self.add(name, query, sql)
            return query

        return put
