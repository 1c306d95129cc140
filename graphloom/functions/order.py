"""The total order of mixed JSON values: null < bool < array < string < number < object; objects can't be ordered.

A value's sort key is a string whose byte order is the order of the values; numbers compare as exact decimals. Keys are made once a
row in an Arrow UDF, and sorts, comparisons, minima and maxima then run on plain strings.
"""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jsonfns import Number, parse

#: Digits of an exponent in a key, and what shifts it to be positive.
EXPONENT, SHIFT = 10, 5_000_000_000


def number_key(text: str) -> str:
    """Sign, exponent and digits; those of negative numbers complemented."""
    sign, digits, exponent = Decimal(text).as_tuple()
    body = "".join(map(str, digits)).lstrip("0")
    if not body:
        return "b"
    power = f"{len(body) + exponent + SHIFT:0{EXPONENT}d}"
    body = body.rstrip("0")
    if not sign:
        return "c" + power + body
    return "a" + "".join(str(9 - int(d)) for d in power + body) + "~"


def value_key(v) -> str:
    if v is None:
        return "0"
    if isinstance(v, bool):
        return "1" + "ft"[v]
    if isinstance(v, list):
        return "2" + "".join(value_key(x) + "\x01" for x in v) + "\x00"
    if isinstance(v, Number):
        return "4" + number_key(v)
    if isinstance(v, str):
        return "3" + "".join("\x02" + chr(ord(c) + 1) if c < "\x03" else c for c in v)
    raise ValueError("objects cannot be ordered")


def _batch(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else value_key(parse(t)) for t in texts], dtype=object)


sort_key_udf = F.pandas_udf(_batch, T.StringType())


def sort_key(text: Column) -> Column:
    """The key of a JSON text; null stays null."""
    return sort_key_udf(text)


def compare(a: Column, op: str, b: Column) -> Column:
    """``op`` (lt, le, gt, ge, eq, ne) in the total order; null if either is null."""
    x, y = sort_key(a), sort_key(b)
    return {"lt": x < y, "le": x <= y, "gt": x > y, "ge": x >= y, "eq": x == y, "ne": x != y}[op]


def _known(text: Column) -> Column:
    return F.when(text.isNotNull() & (F.trim(text) != "null"), text)


def least(text: Column) -> Column:
    """Aggregate: the least value; nulls of both kinds are skipped."""
    return F.min_by(_known(text), sort_key(_known(text)))


def greatest(text: Column) -> Column:
    return F.max_by(_known(text), sort_key(_known(text)))


def total(text: Column) -> Column:
    """Aggregate: the sum of the numbers; nulls are skipped, anything else is an error."""
    return F.sum(_known(text).cast("decimal(38,10)"))


def _checked(texts: pd.Series) -> pd.Series:
    for t in texts:
        v = parse(t) if t is not None else None
        if isinstance(v, list) and len({type(x) for x in v if x is not None}) > 1:
            raise ValueError("a list mixes types")
    return texts


list_checked_udf = F.pandas_udf(_checked, T.StringType())


def list_checked(text: Column) -> Column:
    """An array whose elements are of one type, else an error; nulls fit everywhere."""
    return list_checked_udf(text)
