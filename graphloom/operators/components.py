"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """``src, dst`` (long) -> ``id, component``: the least id reachable.

    Every round each tree hooks onto the least grandparent that a neighbour of one of its nodes has, and paths halve, so
    rounds grow with the logarithm of a component's diameter; the loop goes on until nothing changes. Each round's parents are
    stored (lineage stays short, lost executors cost nothing) and replace the last ones. Minima are combined before each shuffle.
    """
    spark, held, last = edges.sparkSession, [], []
    both = stored(
        edges.select("src", "dst").where("src <> dst").union(edges.select(F.col("dst"), F.col("src")).where("src <> dst")).distinct(),
        "edges",
        held,
    )
    state = both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("near")).selectExpr("id", "least(id, near) AS parent")
    state = stored(state, "parents", last)
    while True:
        up = state.selectExpr("id AS parent", "parent AS top")
        halved = state.join(up.hint("merge"), "parent").select("id", "parent", "top")
        seen = both.join(halved.selectExpr("id AS dst", "top").hint("merge"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("top").alias("near"))
        best = halved.join(seen.hint("merge"), "id").selectExpr("id", "parent", "least(top, near) AS best")
        told = best.selectExpr("id", "parent AS old", "best").union(best.selectExpr("parent AS id", "CAST(NULL AS BIGINT) AS old", "best"))
        now: list[str] = []
        state = stored(told.groupBy("id").agg(F.min("best").alias("parent"), F.min("old").alias("old")), "parents", now)
        done = state.where("parent <> old").isEmpty()
        forget(spark, last)
        last, state = now, state.select("id", "parent")
        if done:
            break
    forget(spark, held)
    return state.select("id", F.col("parent").alias("component"))
