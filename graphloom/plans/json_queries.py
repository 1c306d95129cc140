"""JSON functions over the events' properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsonfns as J
from ..sources import jsonio
from ..storage import shared_path
from .catalogue import register, table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props")


@register("json_extract", "SELECT event_id, coalesce(json_extract(props, '$.k')::VARCHAR, '') AS k, '' AS missing FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", J.json_extract(F.col("props"), "$.k").alias("k"), J.json_extract(F.col("props"), "x/1").alias("missing"))


@register("json_keys", "SELECT event_id, array_to_string(json_keys(props), ',') AS keys, json_array_length(props)::BIGINT AS n, json_valid(props) AS valid FROM events")
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("props")
    return events(spark, sf_dir).select(
        "event_id", F.array_join(J.json_keys(p), ",").alias("keys"), J.json_array_length(p).cast("long").alias("n"), J.json_valid(p).alias("valid")
    )


@register(
    "json_build",
    """SELECT event_id, '{"user":' || user_id || ',"type":' || to_json(event_type)::VARCHAR || '}' AS made,
      '[' || user_id || ',' || json_extract(props, '$')::VARCHAR || ']' AS listed, to_json(event_type)::VARCHAR AS quoted FROM events""",
)
def json_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, kind = J.to_json(F.col("user_id"), T.LongType()), J.to_json(F.col("event_type"), T.StringType())
    return events(spark, sf_dir).select(
        "event_id",
        J.json_object(F.lit("user"), user, F.lit("type"), kind).alias("made"),
        J.json_array(user, J.json_minify(F.col("props"))).alias("listed"),
        kind.alias("quoted"),
    )


@register(
    "json_merge_patch",
    """SELECT event_id, json_merge_patch(props, '{"extra":[1,2],"k":null}')::VARCHAR AS merged FROM events""",
)
def json_merge_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", J.json_merge_patch(F.col("props"), F.lit('{"extra":[1,2],"k":null}')).alias("merged"))


@register("json_contains", """SELECT event_id, json_contains(props, '{"k":7}') AS has FROM events""")
def json_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", J.json_contains(F.col("props"), F.lit('{"k":7}')).alias("has"))


@register(
    "json_structure",
    "SELECT CASE WHEN k < 256 THEN 'STRUCT(k UINT8)' ELSE 'STRUCT(k UINT16)' END AS shape, count(*) AS n FROM (SELECT json_extract(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1",
)
def json_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(J.json_structure(F.col("props")).alias("shape")).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


@register("json_minify", """SELECT event_id, '{"k":' || json_extract(props, '$.k')::VARCHAR || '}' AS small FROM events""")
def json_minify(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.regexp_replace("props", ":", " :\n ")
    return events(spark, sf_dir).select("event_id", J.json_minify(J.cast_to_json(spaced)).alias("small"))


@register(
    "json_object_null_key",
    """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '{"a":null}' ELSE '{"a":null,"odd":' || user_id || '}' END AS made, '[null,' || user_id || ']' AS listed FROM events""",
)
def json_object_null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, nothing = J.json_quote(F.col("user_id"), T.LongType()), F.lit(None).cast("string")
    key = F.when(F.col("user_id") % 2 != 0, "odd")
    return events(spark, sf_dir).select("event_id", J.json_object(F.lit("a"), nothing, key, user).alias("made"), J.json_array(nothing, user).alias("listed"))


@register("json_scan", "SELECT event_id, user_id, json_extract(props, '$.k')::BIGINT AS k, [user_id, event_id] AS pair FROM events WHERE event_id % 10 <> 0")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events written as lines of JSON, every tenth of them broken, and scanned with inferred types."""
    line = F.to_json(F.struct("event_id", "user_id", F.from_json("props", "k long").alias("props"), F.array("user_id", "event_id").alias("pair")))
    path = shared_path(spark, "lines")
    events(spark, sf_dir).select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), line)).otherwise(line)).write.text(path)
    return jsonio.scan(spark, path, ignore_errors=True).where("event_id IS NOT NULL").select("event_id", "user_id", F.col("props.k").alias("k"), "pair")


@register("json_rejected", "SELECT count(*) AS broken FROM events WHERE event_id % 10 = 0")
def json_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "lines")
    events(spark, sf_dir).select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))).write.text(path)
    return jsonio.rejected(spark, path).agg(F.count(F.lit(1)).alias("broken"))


@register("json_array_file", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def json_array_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations exported as one JSON array and read back."""
    path = shared_path(spark, "array")
    jsonio.export_array(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return jsonio.scan(spark, path)


@register("database_export", "SELECT n_name, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def database_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, names = shared_path(spark, "export"), ["nation", "customer"]
    jsonio.export_database({n: table(spark, sf_dir, n) for n in names}, path)
    t = jsonio.import_database(spark, path, names)
    return t["nation"].join(t["customer"], F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"))
