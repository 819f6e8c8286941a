"""Queries by name: a function of the input views, and SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.fixtures import Inputs, duckdb_ctes
from docloom.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a function of Inputs; sql is what follows the views' common table expressions."""

    def add(f: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(Inputs(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql is not None:
            text = sql.strip()
            head = duckdb_ctes(*views) if views else ""
            if head and text.upper().startswith("WITH "):
                text, head = text[5:], head.rstrip() + ", "
            ORACLES[f.__name__] = head + text
        return f

    return add
