"""Named queries of the core library and the SQL that each must agree with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ("tokens", "lines", "order", "scores", "catalog", "compare", "verses", "files", "reports", "upkeep", "speech", "stores")


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives its rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


for _name in MODULES:
    importlib.import_module(f"strophe.queries.{_name}")
