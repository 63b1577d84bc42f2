"""All queries of the library by name, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str | Callable[[], str]] = {}
MODULES = ("detections", "labels", "tables", "rows", "jobs", "evaluation", "files", "media", "models", "videos", "colors")


def query(sql: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tagmill.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql if isinstance(sql, str) else sql() for name, sql in _SQL.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["flagship_result_rows"](spark, sf_dir)
