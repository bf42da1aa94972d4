"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """Queries, their SQL, and a decorator that adds a function under its name."""
    queries: dict[str, Query] = {}
    texts: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(function: Query) -> Query:
            queries[function.__name__] = function
            if sql:
                texts[function.__name__] = sql
            return function

        return add

    return queries, texts, query
