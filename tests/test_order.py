from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import order
from graphloom.functions.jsonfns import parse
from graphloom.sources import typemap

ASCENDING = [
    "null", "false", "true", "[]", "[null]", "[1]", "[1,2]", "[2]", '""', '"\\u0000"', '"a"', '"ab"', '"é"', "-1e20", "-12345678901234567890.5", "-12345678901234567890",
    "-1.25", "-1.2", "-0.001", "0", "0.0010", "1", "9007199254740992", "9007199254740993", "1e20",
]


def test_keys_follow_the_order():
    keys = [order.value_key(parse(t)) for t in ASCENDING]
    for (i, a), (j, b) in itertools.combinations(enumerate(k.encode() for k in keys), 2):
        assert a < b, (ASCENDING[i], ASCENDING[j])
    assert order.value_key(parse("1.0")) == order.value_key(parse("1")) and order.value_key(parse("-0")) == order.value_key(parse("0"))
    with pytest.raises(ValueError):
        order.value_key({})


def test_columns(spark):
    df = spark.createDataFrame([(t,) for t in [*ASCENDING, None]], "t string")
    r = df.agg(order.least(F.col("t")).alias("low"), order.greatest(F.col("t")).alias("high")).first()
    assert (r["low"], r["high"]) == ("false", "1e20")
    got = df.where(order.compare(F.col("t"), "lt", F.lit('"a"'))).count()
    assert got == ASCENDING.index('"a"')
    assert df.limit(0).agg(order.total(F.col("t")).alias("s")).first()["s"] is None
    with pytest.raises(Exception, match="mixes types"):
        spark.range(1).select(order.list_checked(F.lit('[1, "a"]'))).collect()


def test_type_names():
    assert typemap.parse("INTEGER[2][3]") == T.ArrayType(T.ArrayType(T.IntegerType()))
    assert typemap.parse('STRUCT("a b" DECIMAL(10, 2), m MAP(VARCHAR, BIGINT[]))') == T.StructType(
        [T.StructField("a b", T.DecimalType(10, 2)), T.StructField("m", T.MapType(T.StringType(), T.ArrayType(T.LongType())))]
    )
    assert typemap.property_type("Point") == T.StringType()
    with pytest.raises(ValueError):
        typemap.parse("TIME")
