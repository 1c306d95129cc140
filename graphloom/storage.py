"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; where that is missing, as in tests on one machine, a temporary folder stands in."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            root = tempfile.mkdtemp(prefix="graphloom-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/graphloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, kept: list[str] | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if kept is not None:
        kept.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Removes stored tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    paths.clear()


class Loop:
    """State of an iterative algorithm: every round is cached, every ``every``-th is written so that lineage stays short.

    A lost executor costs at most the rounds since the last written table.
    """

    def __init__(self, every: int = 4) -> None:
        self.every, self.round, self.cached = every, 0, []

    def keep(self, df: DataFrame, name: str = "round") -> DataFrame:
        self.round += 1
        df = stored(df, name) if self.round % self.every == 0 else df.persist()
        self.cached.append(df)
        if len(self.cached) > 2:  # the round before last feeds nothing any more
            self.cached.pop(0).unpersist()
        return df
