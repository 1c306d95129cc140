"""Spanning forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import GraphError, ProjectedGraph
from ..storage import stored
from .components import components


def spanning_forest(graph: ProjectedGraph, variant: str = "min", weight: str | None = None) -> DataFrame:
    """Least or largest spanning forest of the undirected multigraph: ``rel, src, dst, forest_id``.

    Boruvka rounds under the strict order (weight, src, dst, rel), reversed for ``max``: every component takes its first outgoing
    edge, so the forest is unique and rounds grow with the logarithm of the nodes. Loops never count. ``forest_id`` is the tree's least node.
    """
    if variant not in ("min", "max"):
        raise GraphError("variant must be min or max.")
    if weight is not None:
        if weight not in graph.edges.columns:
            raise GraphError(f"Cannot find property: {weight}")
        if not isinstance(graph.edges.schema[weight].dataType, T.NumericType):
            raise GraphError(f"Provided weight property is not numerical: {weight}")
    w = F.col(weight) if weight else F.lit(1)
    sign = 1 if variant == "min" else -1
    key = F.struct((w.cast("double") * sign).alias("w"), (F.col("src") * sign).alias("s"), (F.col("dst") * sign).alias("d"), (F.col("rel") * sign).alias("r"))
    left = stored(graph.edges.where("src <> dst").select("src", "dst", "rel", key.alias("key"), F.col("src").alias("a"), F.col("dst").alias("b")), "edges")
    taken, n = None, 0
    while left.limit(1).count():
        ends = left.select("a", "b", "src", "dst", "rel", "key").union(left.select("b", "a", "src", "dst", "rel", "key"))
        pick = ends.groupBy("a").agg(F.min_by(F.struct("b", "src", "dst", "rel"), "key").alias("e"))
        pick = stored(pick.select("a", "e.b", "e.src", "e.dst", "e.rel"), "picked")
        new = pick.select("src", "dst", "rel").distinct()
        taken = new if taken is None else taken.unionByName(new)
        whole = components(pick.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        for c in ("a", "b"):
            top = whole.select(F.col("id").alias(c), F.col("component").alias("top"))
            left = left.join(top, c, "left").withColumn(c, F.coalesce("top", c)).drop("top")
        left = stored(left.where("a <> b"), "edges")
        n += 1
    if taken is None:
        return graph.edges.limit(0).select("rel", "src", "dst", F.col("src").alias("forest_id"))
    trees = components(taken.select("src", "dst"))
    return taken.join(trees.select(F.col("id").alias("src"), F.col("component").alias("forest_id")), "src").select("rel", "src", "dst", "forest_id")
