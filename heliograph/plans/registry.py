"""All registered queries of the library itself. Each names the inventory row that it covers."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}
_MODULES = ("scan_queries", "index_queries", "sequence_queries", "geo_vector_queries", "set_queue_queries", "scalar_queries", "stream_queries", "people_queries", "detail_queries", "rules_queries", "ladder_queries", "scan_more_queries", "stored_index_queries", "memory_queries", "region_queries", "geometry_queries", "upkeep_queries")


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL where SQL can express it."""

    def add(f: Query) -> Query:
        _FOUND[name] = (f, sql)
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        import_module(f"heliograph.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in _FOUND.items() if s is not None}
