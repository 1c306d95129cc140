"""Type names of foreign systems as Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Simple type names. Unsigned types take the next wider signed one, 128-bit ones the widest decimal.
SIMPLE = {
    "BOOLEAN": T.BooleanType(), "BOOL": T.BooleanType(), "TINYINT": T.ByteType(), "INT8": T.ByteType(), "SMALLINT": T.ShortType(), "INT16": T.ShortType(),
    "INTEGER": T.IntegerType(), "INT": T.IntegerType(), "INT32": T.IntegerType(), "BIGINT": T.LongType(), "INT64": T.LongType(), "SERIAL": T.LongType(),
    "UTINYINT": T.ShortType(), "UINT8": T.ShortType(), "USMALLINT": T.IntegerType(), "UINT16": T.IntegerType(), "UINTEGER": T.LongType(), "UINT32": T.LongType(),
    "UBIGINT": T.DecimalType(20, 0), "UINT64": T.DecimalType(20, 0), "HUGEINT": T.DecimalType(38, 0), "INT128": T.DecimalType(38, 0), "UINT128": T.DecimalType(38, 0),
    "FLOAT": T.FloatType(), "REAL": T.FloatType(), "DOUBLE": T.DoubleType(), "VARCHAR": T.StringType(), "STRING": T.StringType(), "TEXT": T.StringType(),
    "UUID": T.StringType(), "JSON": T.StringType(), "BLOB": T.BinaryType(), "BYTEA": T.BinaryType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(),
    "TIMESTAMP_S": T.TimestampNTZType(), "TIMESTAMP_MS": T.TimestampNTZType(), "TIMESTAMP_NS": T.TimestampNTZType(), "TIMESTAMP WITH TIME ZONE": T.TimestampType(),
    "TIMESTAMP_TZ": T.TimestampType(), "INTERVAL": T.DayTimeIntervalType(),
}
#: Property types of a graph database's schema listing.
PROPERTY = {
    "Long": T.LongType(), "Integer": T.LongType(), "Double": T.DoubleType(), "Float": T.DoubleType(), "Boolean": T.BooleanType(), "Date": T.DateType(),
    "LocalDateTime": T.TimestampNTZType(), "DateTime": T.TimestampType(), "String": T.StringType(), "LongArray": T.ArrayType(T.LongType()),
    "DoubleArray": T.ArrayType(T.DoubleType()), "StringArray": T.ArrayType(T.StringType()), "BooleanArray": T.ArrayType(T.BooleanType()),
}


def _split(text: str) -> list[str]:
    out, depth, quoted = [""], 0, False
    for c in text:
        quoted ^= c == '"'
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out if x.strip()]


def parse(text: str) -> T.DataType:
    """A type name; a trailing bracket peels the outermost dimension, so ``INT[2][3]`` holds three arrays of two."""
    t = text.strip()
    if t.endswith("]"):
        return T.ArrayType(parse(t[: t.rindex("[")]))
    up = t.upper()
    if up in SIMPLE:
        return SIMPLE[up]
    m = re.fullmatch(r"(\w+)\s*\((.*)\)", t, re.S)
    if not m:
        raise ValueError(f"Unsupported type: {text}")
    kind, inner = m[1].upper(), _split(m[2])
    if kind in ("DECIMAL", "NUMERIC"):
        return T.DecimalType(int(inner[0]), int(inner[1]) if len(inner) > 1 else 0)
    if kind in ("VARCHAR", "CHAR"):
        return T.StringType()
    if kind == "MAP":
        return T.MapType(parse(inner[0]), parse(inner[1]))
    if kind in ("STRUCT", "UNION"):
        fields = []
        for f in inner:
            name, kind_ = re.fullmatch(r'("[^"]*"|\S+)\s+(.*)', f, re.S).groups()
            fields.append(T.StructField(name.strip('"'), parse(kind_)))
        return T.StructType(([T.StructField("tag", T.StringType())] if kind == "UNION" else []) + fields)
    raise ValueError(f"Unsupported type: {text}")


def property_type(name: str) -> T.DataType:
    """A listed property's type; text for what isn't known."""
    return PROPERTY.get(name, T.StringType())
