"""Collects the registered queries of every topic module."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TOPICS = (
    "features", "lines", "elevation", "spatial", "registers", "plan", "network", "imagery", "traces", "terrain", "imports", "doors", "meshes", "details",
)

Query = Callable[[SparkSession, str], DataFrame]


class Topic:
    """Queries of one subject and, where whole-table SQL is feasible, their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def register(function: Query) -> Query:
            self.queries[function.__name__] = function
            if sql is not None:
                self.sql[function.__name__] = sql
            return function

        return register


def _topics():
    for name in TOPICS:
        yield importlib.import_module(f"mapweave.registry.{name}").topic


def all_queries() -> dict[str, Query]:
    merged: dict[str, Query] = {}
    for topic in _topics():
        merged.update(topic.queries)
    return merged


def all_sql() -> dict[str, str]:
    merged: dict[str, str] = {}
    for topic in _topics():
        merged.update(topic.sql)
    return merged
