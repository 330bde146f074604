"""Named queries with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalog:
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name!r} is registered twice")
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = sql

    def extend(self, other: Catalog) -> None:
        for name, query in other.queries.items():
            self.add(name, query, other.sql.get(name))
