"""How a query and its SQL twin are registered together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bondsight.sources.views import oracle, view

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None, **ctes: str) -> Callable[[Query], Query]:
        """Register a function of (load), where load(view name) gives a DataFrame; sql: its twin, with extra views."""

        def add(f: Callable) -> Callable:
            self.queries[name] = lambda spark, sf_dir: f(lambda v: view(spark, sf_dir, v))
            if sql:
                self.oracles[name] = oracle(sql, **ctes)
            return f

        return add
