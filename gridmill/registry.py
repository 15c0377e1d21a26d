"""Queries of the library's own operators, and the SQL they are checked against."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name. sql: DuckDB SQL over {views}, None where SQL can't express it."""
    from gridmill.plans.views import oracle

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return add


def load() -> None:
    """Import every module of queries."""
    from gridmill import plans

    for m in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"gridmill.plans.{m.name}")


load()
