"""JSON files as tables, and tables as JSON arrays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("auto", "array", "unstructured")


def detect(spark: SparkSession, path: str, lenient: int = 0) -> str:
    """``array`` if the text starts with a bracket, ``newline`` if its first line is a whole record, else ``unstructured``.

    With ``lenient``, for files with broken records, half of the first ``lenient`` lines that are whole objects make it ``newline``.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    for row in lines.limit(1).collect():
        line = row["value"].strip()
        if line.startswith("["):
            return "array"
        whole = spark.range(1).select(F.try_parse_json(F.lit(line)).isNotNull().alias("ok")).first()["ok"]
        if lenient and not whole:
            known = F.count(F.when(F.try_parse_json("value").isNotNull(), F.json_object_keys("value")))
            whole = lines.limit(lenient).agg((2 * known >= F.count(F.lit(1))).alias("ok")).first()["ok"]
        return "newline" if whole else "unstructured"
    return "newline"


def scan(
    spark: SparkSession, path: str, format: str = "auto", schema: T.StructType | str | None = None, sample_size: int = 2048,
    ignore_errors: bool = False, maximum_depth: int = 10, auto_detect: bool = True,
) -> DataFrame:
    """Reads JSON. Without a schema it is inferred and columns stand in the order in which keys first appear.

    Values that lie deeper than ``maximum_depth`` stay JSON text. Newline-delimited files are split over tasks; arrays and unstructured ones are read a file a task. Records that can't be read fail
    the scan, or with ``ignore_errors`` are left out; :func:`rejected` lists those of newline-delimited files.
    """
    format = format.lower()
    if format not in FORMATS:
        raise ValueError(f"Invalid JSON file format: Must be one of {', '.join(f.upper() for f in FORMATS)}.")
    if sample_size <= 0 or maximum_depth <= 0:
        raise ValueError("SAMPLE_SIZE and MAXIMUM_DEPTH must be positive.")
    if not auto_detect and schema is None:
        raise ValueError("When AUTO_DETECT is set to false, a schema is required.")
    kind = detect(spark, path, sample_size if ignore_errors else 0) if format == "auto" else format
    reader = spark.read.option("mode", "DROPMALFORMED" if ignore_errors else "FAILFAST").option("multiLine", kind != "newline")
    if schema is not None:
        return reader.schema(schema).json(path)
    df = reader.json(path)
    if shallow(df.schema, maximum_depth) != df.schema:
        df = reader.schema(shallow(df.schema, maximum_depth)).json(path)
    if kind == "newline":
        lines = spark.read.text(path).where(F.trim("value") != "").limit(sample_size)
        keys = lines.select(F.posexplode(F.json_object_keys("value")).alias("at", "key"))
        order = [r["key"] for r in keys.groupBy("key").agg(F.min("at").alias("at")).orderBy("at", "key").collect()]
        known = [k for k in order if k in df.columns]
        df = df.select(*[f"`{c}`" for c in [*known, *[c for c in df.columns if c not in known]]])
    return df


def shallow(kind: T.DataType, depth: int) -> T.DataType:
    """``kind`` with whatever lies deeper than ``depth`` levels as text; a record is one level."""
    if isinstance(kind, (T.StructType, T.ArrayType)) and depth <= 0:
        return T.StringType()
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, shallow(f.dataType, depth - 1), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(shallow(kind.elementType, depth - 1), kind.containsNull)
    return kind


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """``file, record``: the lines that a scan with ``ignore_errors`` leaves out because they are no JSON objects."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("record")).where(F.trim("record") != "")
    return lines.where(F.json_object_keys("record").isNull() | F.try_parse_json("record").isNull())


def export_array(df: DataFrame, path: str) -> None:
    """Writes all rows as one JSON array in one file, a record a line. The single task streams, it holds one batch at a time."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, first = None, True
        for batch in batches:
            for text in batch["value"]:
                if held is not None:
                    yield pd.DataFrame({"value": [("[" if first else "") + held + ","]})
                    first = False
                held = text
        yield pd.DataFrame({"value": [("[" if first else "") + (held or "") + "]"]})

    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    rows.coalesce(1).mapInPandas(lines, "value string").write.text(path)


def export_database(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as Parquet below ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def import_database(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
