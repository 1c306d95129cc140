"""Every query of the engine with the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "graph_two_hops"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query; one without SQL is held against brute force in the tests."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from . import engine_queries, gql_queries, graph_queries, json_queries, pattern_queries, text_queries, vector_queries  # noqa: E402, F401
