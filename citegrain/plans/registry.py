"""A registry of queries: each a function of (spark, sf_dir), with SQL for the oracle if there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citegrain.plans import fixtures

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
        def add(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = fixtures.sql(views, sql)
            return query

        return add
