"""Named queries and their SQL oracles.

A query is registered with the statement that DuckDB runs for the same rows; queries over
the engagement model's tables share the table definitions in `analogue.SQL`.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


for _name in ("relational", "resolution", "statistics"):
    importlib.import_module(f"lanternfish.plans.{_name}")
