"""Node embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import ProjectedGraph
from ..storage import Loop, stored


def random_walks(graph: ProjectedGraph, length: int = 10, per_node: int = 5, seed: int = 42) -> DataFrame:
    """``id, walk, nodes``: uniform walks over the simple graph. A step joins with numbered neighbours, so no adjacency list is collected."""
    from pyspark.sql import window as W

    order = W.Window.partitionBy("src").orderBy("dst")
    near = graph.simple().withColumn("nth", F.row_number().over(order) - 1)
    degree = near.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    near = stored(near.select(F.col("src").alias("at"), F.col("dst").alias("to"), "nth"), "near")
    degree = stored(degree.withColumnRenamed("src", "at"), "degree")
    loop = Loop()
    walks = graph.nodes.select("id", F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("walk"))
    walks = walks.select("id", "walk", F.col("id").alias("at"), F.array("id").alias("nodes"))
    for step in range(length - 1):
        draw = F.pmod(F.xxhash64(F.lit(seed), "id", "walk", F.lit(step)), F.col("deg"))
        walks = walks.join(degree, "at", "left").withColumn("nth", draw).join(near, ["at", "nth"], "left")
        # a walk without a way on stays where it is
        walks = loop.keep(
            walks.select("id", "walk", F.coalesce("to", "at").alias("at"), F.when(F.col("to").isNotNull(), F.concat("nodes", F.array("to"))).otherwise(F.col("nodes")).alias("nodes"))
        )
    return walks.select("id", "walk", "nodes")


def node2vec(graph: ProjectedGraph, dimensions: int = 64, length: int = 10, per_node: int = 5, seed: int = 42) -> DataFrame:
    """``id, embedding array<float>``: skip-gram over walks (return and in-out weights one, so plain walks)."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    words = random_walks(graph, length, per_node, seed).select(F.transform("nodes", lambda x: x.cast("string")).alias("words"))
    model = Word2Vec(vectorSize=dimensions, minCount=0, inputCol="words", outputCol="v", seed=seed, maxIter=1).fit(words)
    found = model.getVectors().select(F.col("word").cast("long").alias("id"), vector_to_array("vector", "float32").alias("embedding"))
    return graph.nodes.select("id").join(found, "id")
