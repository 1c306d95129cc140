"""Attached databases: foreign tables under one name, through JDBC, SQLite or given DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..graph import GraphCatalogue, register_from_tables
from . import sqlite


class Attached:
    """Tables of one database, opened when first asked for and kept until :meth:`clear_cache`."""

    def __init__(self, names: Callable[[], list[str]], load: Callable[[str], DataFrame], run: Callable[[str], DataFrame] | None = None, skip_unsupported: bool = False) -> None:
        self._names, self._load, self._run, self._skip = names, load, run, skip_unsupported
        self._held: dict[str, DataFrame] = {}

    def table_names(self) -> list[str]:
        return self._names()

    def table(self, name: str) -> DataFrame:
        if name not in self._held:
            if name not in self._names():
                raise ValueError(f"Table {name} does not exist")
            self._held[name] = self._load(name)
        return self._held[name]

    def sql_query(self, text: str) -> DataFrame:
        """Hands a SELECT to the database as it is; anything else is refused."""
        if not re.match(r"\s*(select|with)\b", text, re.I):
            raise ValueError("sql_query takes SELECT statements only.")
        if self._run is None:
            raise ValueError("this database takes no SQL text")
        return self._run(text)

    def clear_cache(self) -> None:
        for df in self._held.values():
            df.unpersist()
        self._held.clear()

    def graph(self) -> tuple[GraphCatalogue, dict[str, str]]:
        """The graph of the tables that follow the naming rules, with the reasons of those that don't."""
        tables, failed = {}, {}
        for n in self.table_names():
            try:
                tables[n] = self.table(n)
            except Exception as e:
                if not self._skip:
                    raise
                failed[n] = str(e).splitlines()[0]
        graph, skipped = register_from_tables(tables)
        return graph, skipped | failed


def attach_sqlite(spark: SparkSession, path: str, all_varchar: bool = False, skip_unsupported: bool = False) -> Attached:
    sqlite.register(spark)
    load = lambda n: spark.read.format("sqlite_table").options(path=path, table=n, all_varchar=str(all_varchar).lower()).load()
    return Attached(lambda: sqlite.table_names(path), load, None, skip_unsupported)


def attach_jdbc(spark: SparkSession, url: str, schema: str = "public", skip_unsupported: bool = False, **options: str) -> Attached:
    """Any database with a JDBC driver on the class path; filters, columns, limits and aggregates are pushed down by Spark."""
    base = lambda: spark.read.format("jdbc").option("url", url).options(**options)
    listed = f"SELECT table_name FROM information_schema.tables WHERE table_schema = '{schema}'"
    names = lambda: [r[0] for r in base().option("query", listed).load().collect()]
    return Attached(names, lambda n: base().option("dbtable", f'{schema}."{n}"').load(), lambda q: base().option("query", q).load(), skip_unsupported)


def attach_frames(spark: SparkSession, tables: Mapping[str, DataFrame]) -> Attached:
    """DataFrames as a database; SQL text sees them as temporary views."""

    def run(text: str) -> DataFrame:
        for n, df in tables.items():
            df.createOrReplaceTempView(n)
        return spark.sql(text)

    return Attached(lambda: sorted(tables), lambda n: tables[n], run)
