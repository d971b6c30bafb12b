"""Named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    """Query name -> callable, and SQL where SQL can express it."""

    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator that registers a query under ``name``."""

        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is there already")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register

    def update(self, other: "Registry") -> None:
        for name, fn in other.queries.items():
            self.add(name, other.sql.get(name))(fn)
