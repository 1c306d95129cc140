"""Nearest neighbours over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vectors
from .catalogue import register, table

#: Lists of the inverted file that a search reads, of 16: recall@10 is 0.99, 0.99 and 0.945 at scale factors 0.001, 0.01 and 0.1 (with 6: 0.76, 0.86 and 0.72).
PROBES = 12
_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"
_V = "embedding::DOUBLE[]"
_SQL = {
    "cosine": f"1 - list_cosine_similarity({_V}, {_Q})",
    "l2": f"list_distance({_V}, {_Q})",
    "l2sq": f"list_distance({_V}, {_Q}) ** 2",
    "ip": f"list_inner_product({_V}, {_Q})",
}


def rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return df, df.orderBy("id").first()["embedding"]


def _nearest(metric: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, vector = rows(spark, sf_dir)
        return vectors.knn(df, "embedding", vector, 10, metric).select("id", F.round(F.col("distance") + 0.0, 6).alias("distance"))

    return query


for _metric, _sql in _SQL.items():
    register(f"knn_{_metric}", f"SELECT vec_id AS id, round({_sql} + 0.0, 6) AS distance FROM embeddings ORDER BY {_sql}, vec_id LIMIT 10")(_nearest(_metric))


@register("knn_filtered", f"SELECT vec_id AS id, round({_SQL['l2']}, 6) AS distance FROM embeddings WHERE label = 3 ORDER BY {_SQL['l2']}, vec_id LIMIT 5")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, vector = rows(spark, sf_dir)
    return vectors.knn(df, "embedding", vector, 5, "l2", F.col("label") == 3).select("id", F.round("distance", 6).alias("distance"))


def _sq(limit: int) -> str:
    scaled = "list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))"
    codes = f"list_transform(embedding, lambda x: sign(x) * floor(abs(x::DOUBLE / ({scaled} / {limit}.0)) + 0.5) * ({scaled} / {limit}.0))"
    return f"""WITH c AS MATERIALIZED (SELECT vec_id, {codes} AS v FROM embeddings),
q AS MATERIALIZED (SELECT v FROM c ORDER BY vec_id LIMIT 1)
SELECT vec_id AS id, round(list_distance(c.v, q.v), 6) AS distance FROM c CROSS JOIN q ORDER BY list_distance(c.v, q.v), vec_id LIMIT 10"""


@register("knn_sq8", _sq(127))
def knn_sq8(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, vector = rows(spark, sf_dir)
    return vectors.quantized(df, "embedding", "l2", "sq8").search(vector, 10).select("id", F.round("distance", 6).alias("distance"))


@register("knn_sq16", _sq(32767))
def knn_sq16(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, vector = rows(spark, sf_dir)
    return vectors.quantized(df, "embedding", "l2", "sq16").search(vector, 10).select("id", F.round("distance", 6).alias("distance"))


@register("knn_sq8_reranked", f"SELECT vec_id AS id, round({_SQL['l2']}, 6) AS distance FROM embeddings ORDER BY {_SQL['l2']}, vec_id LIMIT 10")
def knn_sq8_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, vector = rows(spark, sf_dir)
    return vectors.quantized(df, "embedding", "l2", "sq8", rerank=True).search(vector, 10).select("id", F.round("distance", 6).alias("distance"))


@register(
    "knn_join",
    """SELECT query, id, round(d, 6) AS distance FROM (SELECT q.vec_id AS query, r.vec_id AS id, list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS d,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), r.vec_id) AS n
      FROM embeddings q CROSS JOIN embeddings r WHERE q.vec_id % 50 = 0) WHERE n <= 5""",
)
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every id divisible by 50, against all rows."""
    df, _ = rows(spark, sf_dir)
    queries = df.where(F.col("id") % 50 == 0).select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
    return vectors.knn_join(queries, df, "embedding", 5, "l2").select("query", "id", F.round("distance", 6).alias("distance"))


@register("knn_inverted_recall", "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def knn_inverted_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the inverted file finds nine in ten of the true ten nearest, over every id divisible by 50."""
    df, _ = rows(spark, sf_dir)
    queries = df.where(F.col("id") % 50 == 0).select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
    index = vectors.ivf(df.select("id", "embedding"), "embedding", lists=16, keep=True)
    found = index.search_all(queries, 10, probes=PROBES).select("query", "id", F.lit(1).alias("hit"))
    true = vectors.knn_join(queries, df, "embedding", 10, "l2").select("query", "id")
    both = true.join(found, ["query", "id"], "left").agg(F.countDistinct("query").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return both.select("queries", (F.col("recall") >= 0.9).alias("enough"))


@register("knn_inverted_file")
def knn_inverted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, vector = rows(spark, sf_dir)
    return vectors.ivf(df, "embedding", lists=16).search(vector, 10, probes=PROBES)
