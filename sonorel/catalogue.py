"""Named queries over the standard tables, each with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sonorel.plans import kernels, relations, scoring, waves

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (scoring, relations, waves, kernels)


def queries() -> dict[str, Query]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
