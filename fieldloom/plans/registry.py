"""Where queries are registered: a function over ``Relations`` and, where SQL has it, the SQL over the same relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.sources.relations import Relations, adapter_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of ``Relations`` under its own name."""

    def add(f: Callable[[Relations], DataFrame]) -> Callable[[Relations], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Relations(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = adapter_sql(sql)
        return f

    return add
