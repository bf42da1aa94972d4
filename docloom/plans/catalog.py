"""The named queries of the library and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import build_queries, chunk_queries, graph_queries, line_queries, lookup_queries, record_queries, outline_queries, scalar_queries, search_queries, table_queries, whole_queries

MODULES = (search_queries, scalar_queries, chunk_queries, graph_queries, table_queries, line_queries, outline_queries, build_queries, whole_queries, lookup_queries, record_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.knn_tenant_join_topk(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
