"""SQLite files through a Python data source: ``spark.read.format("sqlite_table").option("table", ...).load(path)``.

The file must be reachable from every executor. Rows are dealt by ranges of rowid; comparisons are pushed into the query.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
)

OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def spark_type(declared: str) -> T.DataType:
    """The column type of a declared one, by its name; the date and time test comes before the integer one."""
    d = (declared or "").upper()
    if not d:
        return T.BinaryType()
    if "DATETIME" in d or "TIMESTAMP" in d:
        return T.TimestampNTZType()
    if d == "DATE":
        return T.DateType()
    if "INT" in d or "BOOL" in d:
        return T.LongType()
    if any(w in d for w in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if "BLOB" in d:
        return T.BinaryType()
    if any(w in d for w in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        return T.DoubleType()
    return T.StringType()


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class Range(InputPartition):
    def __init__(self, low: int | None, high: int | None) -> None:
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """Options: ``path``, ``table``, ``all_varchar`` (every column as text) and ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> T.StructType:
        with opened(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"Table {self.options['table']} does not exist")
        text = self.options.get("all_varchar", "false").lower() == "true"
        return T.StructType([T.StructField(c[1], T.StringType() if text else spark_type(c[2])) for c in columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(schema, dict(self.options))


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.schema, self.options, self.wheres = schema, options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if type(f) in OPERATORS and column and isinstance(f.value, (int, float, str)) and self.options.get("all_varchar", "false") != "true":
                self.wheres.append((f"{quoted(column)} {OPERATORS[type(f)]} ?", f.value))
            elif isinstance(f, (IsNull, IsNotNull)) and column:
                self.wheres.append((f"{quoted(column)} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", None))
            else:
                yield f

    def partitions(self) -> list[Range]:
        n = int(self.options.get("partitions", "4"))
        try:
            with opened(self.options["path"]) as db:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.options['table'])}").fetchone()
        except sqlite3.OperationalError:  # a table without rowid is one range
            return [Range(None, None)]
        if low is None:
            return [Range(None, None)]
        step = (high - low) // n + 1
        return [Range(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        import datetime

        wheres, values = [w for w, _ in self.wheres], [v for w, v in self.wheres if "?" in w]
        if partition.low is not None:
            wheres, values = [*wheres, "rowid BETWEEN ? AND ?"], [*values, partition.low, partition.high]
        names = ", ".join(quoted(f.name) for f in self.schema)
        sql = f"SELECT {names} FROM {quoted(self.options['table'])}" + (" WHERE " + " AND ".join(wheres) if wheres else "")
        fits = {T.LongType: int, T.DoubleType: (int, float), T.StringType: str, T.BinaryType: bytes}

        def cell(v, f: T.StructField):
            if v is None:
                return None
            kind = type(f.dataType)
            if self.options.get("all_varchar", "false").lower() == "true":
                return v.decode() if isinstance(v, bytes) else str(v)
            if kind is T.DateType:
                return datetime.date.fromisoformat(v)
            if kind is T.TimestampNTZType:
                return datetime.datetime.fromisoformat(v)
            if not isinstance(v, fits[kind]):
                raise ValueError(f'Mismatch Type Error: column "{f.name}" holds {type(v).__name__}, set all_varchar to read it as text')
            return float(v) if kind is T.DoubleType else v

        with opened(self.options["path"]) as db:
            for row in db.execute(sql, values):
                yield tuple(cell(v, f) for v, f in zip(row, self.schema.fields, strict=True))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)


def table_names(path: str) -> list[str]:
    with opened(path) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
