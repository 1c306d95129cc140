"""Change data capture into versioned snapshots.

A snapshot is a Parquet table dealt by its keys into buckets; ``<root>/v<n>`` holds the buckets that version ``n`` changed. The file ``cursor-<n>.json`` names
the version of every bucket and the last batch applied. It is put in place last and by one rename, so a batch that was interrupted is applied again from the
version before it. Upserts come before deletes; the last change of a key wins.
"""

from __future__ import annotations

import json
import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sqlite


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(upserts, deleted keys) that turn ``old`` into ``new``; rows are compared by a hash of all columns."""
    rest = sorted(c for c in new.columns if c not in keys)
    mark = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in rest]) if rest else F.lit(0)
    before = old.select(*keys, mark.alias("__old"))
    changed = new.withColumn("__new", mark).join(before, keys, "left").where(F.col("__old").isNull() | (F.col("__old") != F.col("__new")))
    return changed.select(*new.columns), old.select(*keys).join(new.select(*keys), keys, "left_anti")


def latest(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of every key by ``order`` (folded before the shuffle)."""
    rest = [c for c in changes.columns if c not in keys]
    folded = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__last"))
    return folded.select(*keys, *[F.col(f"__last.`{c}`").alias(c) for c in rest])


def apply_changes(current: DataFrame, changes: DataFrame, keys: list[str], op: str = "op", order: str = "seq") -> DataFrame:
    """``current`` after ``changes``: ``op`` is ``upsert`` or ``delete``, ``order`` tells which change of a key is last."""
    last = latest(changes, keys, order)
    kept = current.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.where(F.col(op) == "upsert").select(*current.columns))


class Snapshot:
    """A versioned table in a shared folder; a batch rewrites only the buckets of the keys that it changes.

    ``buckets`` is fixed by the first batch: choose it so that a bucket fits a task. Versions that neither the newest cursor nor the
    one before it names are removed.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, buckets: int = 64) -> None:
        self.spark, self.root, self.schema, self.buckets = spark, root.rstrip("/"), schema, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        fs = path.getFileSystem(self._conf)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _cursors(self) -> list[int]:
        return sorted(int(n[7:-5]) for n in self._names(self.root) if n.startswith("cursor-") and n.endswith(".json"))

    def cursor(self, version: int | None = None) -> dict:
        """The newest cursor, or that of a version."""
        known = self._cursors()
        if not known:
            return {"version": 0, "batch": -1, "buckets": self.buckets, "keys": None, "held": {}}
        name = f"{self.root}/cursor-{known[-1] if version is None else version}.json"
        return json.loads("".join(r[0] for r in self.spark.read.text(name).collect()))

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        held = self.cursor()["held"]
        paths = [f"{self.root}/v{v}/__bucket={b}" for b, v in held.items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def change(self, changes: DataFrame, keys: list[str], batch: int, op: str = "op", order: str = "seq") -> None:
        """Applies changes (see ``apply_changes``): writes the buckets that they touch, then the next cursor."""
        now = self.cursor()
        if now["keys"] not in (None, keys):
            raise ValueError(f"the snapshot is dealt by {now['keys']}")
        bucket = F.pmod(F.xxhash64(*keys), F.lit(now["buckets"])).cast("int").alias("__bucket")
        last = latest(changes, keys, order).persist()
        touched = [r[0] for r in last.select(bucket).distinct().collect()]
        version = now["version"] + 1
        current = self.read(touched)
        kept = current.join(last.select(*keys), keys, "left_anti")
        made = kept.unionByName(last.where(F.col(op) == "upsert").select(*current.columns)).select("*", bucket)
        made.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.root}/v{version}")
        last.unpersist()
        held = {b: v for b, v in now["held"].items() if int(b) not in touched}
        held |= {n.split("=")[1]: version for n in self._names(f"{self.root}/v{version}") if n.startswith("__bucket=")}
        fresh = self._path(f"{self.root}/next.json")
        fs = fresh.getFileSystem(self._conf)
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps({"version": version, "batch": batch, "buckets": now["buckets"], "keys": keys, "held": held}).encode()))
        out.close()
        fs.rename(fresh, self._path(f"{self.root}/cursor-{version}.json"))
        used = {version, *held.values(), *now["held"].values()}
        for name in self._names(self.root):
            if name.startswith("v") and int(name[1:]) not in used or name.startswith("cursor-") and int(name[7:-5]) < version - 1:
                fs.delete(self._path(f"{self.root}/{name}"), True)


def sync_stream(changes: DataFrame, snapshot: Snapshot, keys: list[str], checkpoint: str, **trigger):
    """Starts a stream that applies a change feed (``op, seq`` and the columns) to a snapshot, a version a batch; a batch seen before is skipped."""

    def one(batch: DataFrame, number: int) -> None:
        if number > snapshot.cursor()["batch"]:
            snapshot.change(batch, keys, number)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


@dataclass
class SyncStatus:
    tables_synced: int
    rows_upserted: int
    rows_deleted: int
    status: str


class SqliteSync:
    """Keeps snapshots of a SQLite file's tables in step, one tick at a time or in the background.

    Tables named ``node_*`` need one key column, ``rel_*`` and ``csr_rel_*`` two end columns; explicit registrations override the names.
    A table is compared with its last snapshot, so deletes that happened while nothing ran are seen too.
    """

    def __init__(self, spark: SparkSession, path: str, root: str) -> None:
        sqlite.register(spark)
        self.spark, self.path, self.root = spark, path, root
        self.mapping: dict[str, list[str]] = {}
        self.skipped: dict[str, str] = {}
        self._thread: threading.Thread | None = None
        self._stop = threading.Event()
        self.last: SyncStatus | None = None

    def register_node(self, table: str, key: str = "id") -> None:
        self.mapping[table] = [key]

    def register_edge(self, table: str, source: str = "src", target: str = "dst") -> None:
        self.mapping[table] = [source, target]

    def _infer(self) -> None:
        for name in sqlite.table_names(self.path):
            if name in self.mapping:
                continue
            with sqlite.opened(self.path) as db:
                columns = db.execute(f"PRAGMA table_info({sqlite.quoted(name)})").fetchall()
            keys = [c[1] for c in columns if c[5]]
            if name.startswith("node_"):
                if len(keys) == 1:
                    self.mapping[name] = keys
                else:
                    self.skipped[name] = "no single primary key"
            elif name.startswith(("rel_", "csr_rel_")):
                ends = [next((c[1] for c in columns if c[1].lower().startswith(p)), None) for p in (("src",), ("dst", "dest"))]
                if all(ends):
                    self.mapping[name] = keys or [str(e) for e in ends]
                else:
                    self.skipped[name] = "no source and target columns"

    def sync(self) -> SyncStatus:
        """One tick: compares every table with its snapshot and applies what differs."""
        self._infer()
        up = down = 0
        for table, keys in self.mapping.items():
            new = self.spark.read.format("sqlite_table").options(path=self.path, table=table).load()
            snapshot = Snapshot(self.spark, f"{self.root}/{table}", new.schema.simpleString()[7:-1].replace(":", " "))
            upserts, deletes = diff(snapshot.read(), new, keys)
            changes = upserts.withColumn("__op", F.lit("upsert")).unionByName(deletes.withColumn("__op", F.lit("delete")), allowMissingColumns=True)
            changes = changes.withColumn("__seq", F.lit(0)).persist()
            found = dict(map(tuple, changes.groupBy("__op").count().collect()))
            if found:
                snapshot.change(changes, keys, snapshot.cursor()["batch"] + 1, "__op", "__seq")
            changes.unpersist()
            up, down = up + found.get("upsert", 0), down + found.get("delete", 0)
        self.last = SyncStatus(len(self.mapping), up, down, "ok")
        return self.last

    def table(self, name: str) -> DataFrame:
        new = self.spark.read.format("sqlite_table").options(path=self.path, table=name).load()
        return Snapshot(self.spark, f"{self.root}/{name}", new.schema.simpleString()[7:-1].replace(":", " ")).read()

    def start(self, interval: float = 1.0, longest: float = 30.0) -> None:
        """Ticks in the background; after a failure the pause doubles up to ``longest`` seconds."""
        if self._thread is not None:
            raise ValueError("sync is already running")
        self._stop.clear()

        def run() -> None:
            pause = interval
            while not self._stop.wait(pause):
                try:
                    self.sync()
                    pause = interval
                except Exception as e:
                    self.last = SyncStatus(0, 0, 0, f"error: {e}")
                    pause = min(longest, pause * 2)

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._stop.set()
        if self._thread is not None:
            self._thread.join()
        self._thread = None
