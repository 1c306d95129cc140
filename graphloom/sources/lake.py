"""Lake tables without their libraries: a Delta log replayed to its files, an Iceberg table's snapshots."""

from __future__ import annotations

import json
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The parts of a log's actions that a read needs.
ACTIONS = (
    "add struct<path:string,partitionValues:map<string,string>,deletionVector:struct<storageType:string>>, remove struct<path:string>, "
    "metaData struct<schemaString:string,partitionColumns:array<string>,configuration:map<string,string>>, sidecar struct<path:string>"
)
#: Files whose partition values are broadcast at most; the values of more are shuffled.
BROADCAST_FILES = 100_000


def _log_files(spark: SparkSession, root: str, version: int | None) -> tuple[list[str], list[str], str]:
    """Files of the newest checkpoint up to ``version``, the commits after it, and the table's full path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_delta_log")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise ValueError(f"{root} holds no Delta table")
    names = sorted(f.getPath().getName() for f in fs.listStatus(path))
    full = fs.makeQualified(path).toString()
    commits = {int(n[:20]): n for n in names if re.fullmatch(r"\d{20}\.json", n)}
    last = max(commits, default=-1) if version is None else version
    saved: dict[int, dict[int, list[str]]] = {}
    for n in names:
        if m := re.fullmatch(r"(\d{20})\.checkpoint(?:\.(\d{10})\.(\d{10})|\.[0-9a-f-]{36})?\.parquet", n):
            if version is None or int(m[1]) <= version:
                saved.setdefault(int(m[1]), {}).setdefault(int(m[3] or 1), []).append(n)
    # a checkpoint counts once all its parts are there; of several copies one is enough
    whole: dict[int, list[str]] = {}
    for v, kinds in saved.items():
        for n, found in kinds.items():
            if n == 1 or len(found) == n:
                whole[v] = found[:n]
    start = max(whole, default=-1)
    last = max(last, start)
    missing = [v for v in range(start + 1, last + 1) if v not in commits]
    if missing:
        raise ValueError(f"the log of {root} lacks version {missing[0]}")
    return [f"{full}/{n}" for n in whole.get(start, ())], [f"{full}/{commits[v]}" for v in range(start + 1, last + 1)], full.rsplit("/", 1)[0]


def _key(path: str) -> str:
    """A file's path without scheme and host, with the characters escaped that a URI's path may not hold."""
    path = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path)
    return re.sub(r"[^A-Za-z0-9_\-!.~'()*,;:$&+=@/\u0080-\U0010ffff]", lambda m: f"%{ord(m[0]):02X}", path)


def delta_scan(spark: SparkSession, path: str, version: int | None = None, partitions: Column | None = None) -> DataFrame:
    """The table at ``version`` (default: the last). Files added and not removed later are read as Parquet, in one scan.

    The newest whole checkpoint counts first, then the commits after it; a missing commit is an error. The log is parsed on executors; what the
    driver gets is the list of live files, as for any table scan. Partition values meet the rows by file. ``partitions``, a condition on the partition columns,
    leaves files out before they are read. Tables that need what is not read here (deletion vectors, column mapping, sidecar files) are refused.
    """
    saved, commits, root = _log_files(spark, path.rstrip("/"), version)
    log = None
    if commits:
        log = spark.read.schema(ACTIONS).json(commits).withColumn("version", F.regexp_extract("_metadata.file_path", r"(\d{20})\.json", 1).cast("long"))
    if saved:
        rows = spark.read.schema(ACTIONS).parquet(*saved).withColumn("version", F.regexp_extract("_metadata.file_path", r"(\d{20})\.checkpoint", 1).cast("long"))
        log = rows if log is None else log.unionByName(rows)
    if log is None:
        raise ValueError(f"{path} holds no Delta table")
    told = log.agg(F.max_by("metaData", F.when(F.col("metaData").isNotNull(), F.col("version"))).alias("meta"), F.count("sidecar").alias("sidecars")).first()
    meta = told["meta"]
    if meta is None:
        raise ValueError(f"{path} holds no Delta table")
    if told["sidecars"]:
        raise ValueError(f"{path} has a checkpoint with sidecar files, which are not read")
    if ((meta["configuration"] or {}).get("delta.columnMapping.mode") or "none") != "none":
        raise ValueError(f"{path} maps its columns to other names, which is not read")
    schema = T.StructType.fromJson(json.loads(meta["schemaString"]))
    parts = meta["partitionColumns"] or []
    state = log.select(
        "version", F.coalesce("add.path", "remove.path").alias("path"), F.col("add").isNotNull().alias("live"), "add.partitionValues", F.col("add.deletionVector").isNotNull().alias("cut")
    )
    last = state.where("path IS NOT NULL").groupBy("path").agg(F.max_by(F.struct("live", "partitionValues", "cut"), F.struct("version", "live")).alias("s")).where("s.live")
    # an empty value stands for null
    values = [F.expr(f"nullif(s.partitionValues[{_quoted(p)}], '')").cast(schema[p].dataType).alias(p) for p in parts]
    live = last.select("path", F.col("s.cut").alias("__cut"), *values)
    if partitions is not None:
        live = live.where(partitions)
    files = live.collect()
    if any(r["__cut"] for r in files):
        raise ValueError(f"{path} has deletion vectors, which are not read")
    if not files:
        return spark.createDataFrame([], schema)
    names = [unquote(r["path"]) for r in files]
    names = [n if re.match(r"/|[A-Za-z][A-Za-z0-9+.-]*:/", n) else f"{root}/{n}" for n in names]
    df = spark.read.schema(T.StructType([f for f in schema.fields if f.name not in parts])).parquet(*names)
    if not parts:
        return df.select(*schema.names)
    kinds = T.StructType([T.StructField("__file", T.StringType()), *[T.StructField(f"__p{i}", schema[p].dataType) for i, p in enumerate(parts)]])
    own = spark.createDataFrame([(_key(n), *[r[p] for p in parts]) for n, r in zip(names, files, strict=True)], kinds)
    df = df.withColumn("__file", F.regexp_replace("_metadata.file_path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""))
    df = df.join(F.broadcast(own.withColumn("__known", F.lit(True))) if len(files) <= BROADCAST_FILES else own.withColumn("__known", F.lit(True)), "__file", "left")
    known = lambda c: F.when(F.col("__known"), c).otherwise(F.raise_error(F.concat(F.lit("no partition values for "), "__file")))
    return df.select(*[known(F.col(f"__p{parts.index(c)}")).alias(c) if c in parts else c for c in schema.names])


def _quoted(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def iceberg_snapshots(spark: SparkSession, metadata: str) -> DataFrame:
    """``sequence_number, snapshot_id, timestamp_ms, manifest_list`` of a table's metadata file."""
    kind = "`snapshots` array<struct<`sequence-number`:bigint,`snapshot-id`:bigint,`timestamp-ms`:bigint,`manifest-list`:string>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(metadata).select(F.explode("snapshots").alias("s"))
    return rows.select(*[F.col(f"s.`{n}`").alias(n.replace("-", "_")) for n in ("sequence-number", "snapshot-id", "timestamp-ms", "manifest-list")])


def snapshot_at(spark: SparkSession, metadata: str, snapshot_id: int | None = None, timestamp_ms: int | None = None) -> int:
    """The snapshot that a time travel option names; the two options exclude each other."""
    if snapshot_id is not None and timestamp_ms is not None:
        raise ValueError("snapshot id and timestamp are mutually exclusive")
    rows = iceberg_snapshots(spark, metadata)
    if snapshot_id is not None:
        rows = rows.where(F.col("snapshot_id") == snapshot_id)
    if timestamp_ms is not None:
        rows = rows.where(F.col("timestamp_ms") <= timestamp_ms)
    found = rows.agg(F.max_by("snapshot_id", "timestamp_ms").alias("id")).first()["id"]
    if found is None:
        raise ValueError("no snapshot matches")
    return found
