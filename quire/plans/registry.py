"""All registered queries: name -> (Spark query, SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = [
    "text_queries", "chunk_queries", "search_queries", "selection_queries",
    "graph_queries", "persona_queries", "context_queries", "outline_queries",
    "evaluation_queries", "maintenance_queries", "streaming_queries",
]


class Registry:
    def __init__(self) -> None:
        self.entries: dict[str, tuple[Query, str | None]] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn: Query) -> Query:
            if name in self.entries:
                raise ValueError(f"query {name} is registered twice")
            self.entries[name] = (fn, sql)
            return fn

        return keep


def all_queries() -> dict[str, tuple[Query, str | None]]:
    entries: dict[str, tuple[Query, str | None]] = {}
    for module in MODULES:
        part = import_module(f"quire.plans.{module}").registry.entries
        clash = entries.keys() & part.keys()
        if clash:
            raise ValueError(f"queries registered twice: {sorted(clash)}")
        entries.update(part)
    return entries
