"""Nearest neighbours over array columns: exact top-k, scalar quantisation, reranking and an inverted-file index."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import shared_path, stored

METRICS = {"cosine": "cosine", "l2": "l2", "l2sq": "l2sq", "dotproduct": "ip", "dot_product": "ip", "ip": "ip", "inner_product": "ip"}
SEARCH_TYPES = ("auto", "navix", "adaptive_l", "adaptive_g", "blind", "directed", "one_hop", "random", "naive")
#: Blocks of queries in one plan at most.
STORED_BLOCKS = 16
#: Rows scored against a block of queries at once: 2 million distances, 16 MB.
SCORED_ROWS = 2_048
QUANTIZATIONS = {"none": None, "sq8": 127.0, "sq16": 32767.0}


def metric_of(name: str) -> str:
    if name.lower() not in METRICS:
        raise ValueError("Metric must be one of COSINE, L2, L2SQ or DOTPRODUCT.")
    return METRICS[name.lower()]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def with_value(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made(value)``, with ``value`` computed once a row; within the lambda of an array function it would be once an element."""
    return F.transform(F.array(value), made)[0]


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Distance in double precision; ``ip`` is the raw dot product, so the least similar come first when sorted."""
    metric = metric_of(metric)
    if metric == "ip":
        return dot(a, b)
    if metric == "cosine":
        return with_value(F.sqrt(dot(a, a) * dot(b, b)), lambda norm: F.when(norm > 0, 1 - dot(a, b) / norm))
    square = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x
    )
    return F.sqrt(square) if metric == "l2" else square


def _check(k: int, search_type: str, blind: float, directed: float, efs: int) -> None:
    if k <= 0:
        raise ValueError("The value of k must be greater than 0.")
    if efs <= 0:
        raise ValueError("efs must be a positive integer.")
    if search_type not in SEARCH_TYPES:
        raise ValueError(f"Unknown search type {search_type}.")
    if blind >= directed:
        raise ValueError("Blind search upper selectivity threshold must be less than directed search upper selectivity threshold.")


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def knn(
    rows: DataFrame, column: str, vector, k: int, metric: str = "cosine", keep: Column | None = None, search_type: str = "auto",
    efs: int = 200, blind_search_up_sel: float = 0.08, directed_search_up_sel: float = 0.4,
) -> DataFrame:
    """``id, distance`` of the k nearest rows that ``keep`` passes; rows without a vector never match.

    All search modes filter first and are exact. Each task keeps its own k best, so k rows a task are shuffled.
    """
    _check(k, search_type, blind_search_up_sel, directed_search_up_sel, efs)
    own = rows.where(F.col(column).isNotNull())
    if keep is not None:
        own = own.where(keep)
    return own.select("id", distance(F.col(column), literal(vector), metric).alias("distance")).orderBy("distance", "id").limit(k)


def knn_join(queries: DataFrame, rows: DataFrame, column: str, k: int, metric: str = "cosine", block: int = 1024) -> DataFrame:
    """``query, id, distance``: the k nearest rows of every query (``query, vector``).

    Queries are dealt into blocks of about ``block`` by a hash; the driver holds one block's vectors at a time. Each task scores its rows against a
    block by a matrix product and keeps k a query, so a task hands on ``k * block`` rows whatever its size. What ``STORED_BLOCKS`` blocks
    found is stored, so that no plan grows with the queries. Queries without a vector find nothing.
    """
    metric = metric_of(metric)
    return _by_blocks(queries, k, block, lambda names, q: _nearest(rows, column, names, q, k, metric))


def _by_blocks(queries: DataFrame, k: int, block: int, find: Callable[[list, np.ndarray], DataFrame]) -> DataFrame:
    """The k least of what ``find`` gives for the names and vectors of each block of queries."""
    blocks = -(-queries.count() // block)
    dealt = queries.withColumn("__block", F.pmod(F.xxhash64("query"), F.lit(max(blocks, 1))))
    waiting, paths = None, []
    for n in range(blocks):
        own = dealt.where(F.col("__block") == n).select("query", "vector").where("vector IS NOT NULL").collect()
        if own:
            part = _least(find([r["query"] for r in own], np.array([r["vector"] for r in own], dtype=np.float64)), k)
            waiting = part if waiting is None else waiting.unionByName(part)
        if waiting is not None and n % STORED_BLOCKS == STORED_BLOCKS - 1:
            stored(waiting, "nearest", paths)
            waiting = None
    kinds = "query long, id long, distance double"
    done = queries.sparkSession.read.schema(kinds).parquet(*paths) if paths else None
    if waiting is None or done is None:
        found = waiting if done is None else done
        return queries.sparkSession.createDataFrame([], kinds) if found is None else found
    return done.unionByName(waiting)


def _least(found: DataFrame, k: int) -> DataFrame:
    """The k least distances of each query, ties to the lower id."""
    from pyspark.sql import window as W

    order = W.Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def _nearest(rows: DataFrame, column: str, names: list, queries: np.ndarray, k: int, metric: str, asked: np.ndarray | None = None) -> DataFrame:
    """Each task's k nearest rows of every query. ``asked`` says by query and list (a column of ``rows``) whether the query reads that list.

    Rows are scored ``SCORED_ROWS`` at a time, and of these only what is no farther than the k found so far is sorted.
    """
    shared = rows.sparkSession.sparkContext.broadcast((names, queries, asked))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_names, q, reads = shared.value
        squares = (q * q).sum(1)
        far = np.full(len(q), np.inf)
        which, ids, near = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        for whole in batches:
            whole = whole[whole["v"].notna()]
            for at in range(0, len(whole), SCORED_ROWS):
                batch = whole.iloc[at : at + SCORED_ROWS]
                x = np.stack(batch["v"].to_numpy()).astype(np.float64)
                d = q @ x.T
                if metric == "cosine":
                    d = 1 - d / np.sqrt(np.outer(squares, (x * x).sum(1)))
                elif metric != "ip":
                    d = np.maximum(squares[:, None] + (x * x).sum(1)[None] - 2 * d, 0)
                    d = np.sqrt(d) if metric == "l2" else d
                hit = ~(d > far[:, None])  # what is no number stays, as the farthest
                if reads is not None:
                    hit &= reads[:, batch["list"].to_numpy()]
                i, j = np.nonzero(hit)
                which, ids, near = np.concatenate((which, i)), np.concatenate((ids, batch["id"].to_numpy()[j])), np.concatenate((near, d[i, j]))
                order = np.lexsort((ids, near, which))
                which, ids, near = which[order], ids[order], near[order]
                nth = np.arange(len(which)) - np.searchsorted(which, which)
                kept = nth < k
                last = nth == k - 1
                far[which[last]] = near[last]
                which, ids, near = which[kept], ids[kept], near[kept]
        if len(which):
            yield pd.DataFrame({"query": np.asarray(own_names)[which], "id": ids, "distance": near})

    lists = [] if asked is None else ["list"]
    return rows.select("id", F.col(column).alias("v"), *lists).mapInPandas(best, "query long, id long, distance double")


def quantize(vector: Column, quantization: str) -> tuple[Column, Column]:
    """(codes, scale) of a symmetric scalar quantisation: the largest magnitude maps to the code's limit, halves round away from zero."""
    limit = QUANTIZATIONS[quantization]
    peak = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    scale = F.when(peak > 0, peak / limit).otherwise(1.0)
    kind = "tinyint" if quantization == "sq8" else "smallint"
    away = lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5)
    one = lambda x, s: F.greatest(F.lit(-limit), F.least(F.lit(limit), away(x.cast("double") / s))).cast(kind)
    return with_value(scale, lambda s: F.transform(vector, lambda x: one(x, s))), scale


@dataclass(frozen=True)
class QuantizedIndex:
    """``id, codes, scale`` of every vector, with the full vectors for reranking."""

    codes: DataFrame
    rows: DataFrame
    column: str
    metric: str
    quantization: str
    rerank: bool
    #: Stored tables that go with the index.
    paths: list[str] = field(default_factory=list)

    def without(self, ids: DataFrame) -> QuantizedIndex:
        """The index after deleting the rows in ``ids`` (``id``)."""
        gone = ids.select("id")
        return self._with(self.codes.join(gone, "id", "left_anti"), self.rows.join(gone, "id", "left_anti"))

    def with_rows(self, rows: DataFrame) -> QuantizedIndex:
        """The index after inserting or updating ``rows``; only their codes are made."""
        left, own = self.without(rows), rows.where(F.col(self.column).isNotNull())
        return self._with(left.codes.unionByName(_coded(own, self.column, self.quantization)), left.rows.unionByName(own.select(*left.rows.columns)))

    def _with(self, codes: DataFrame, rows: DataFrame) -> QuantizedIndex:
        paths: list[str] = []
        return replace(self, codes=stored(codes, "codes", paths) if self.paths else codes, rows=rows, paths=paths)

    def search(self, vector, k: int, efs: int = 200, search_type: str = "auto") -> DataFrame:
        """The k nearest by quantised distance, or with ``rerank`` the k best by full distance among ``max(k, efs)`` of them."""
        _check(k, search_type, 0.0, 1.0, efs)
        q, scale = quantize_vector(vector, self.quantization)
        stored_vector = with_value(F.col("scale"), lambda s: F.transform("codes", lambda c: c.cast("double") * s))
        query = literal([c * scale for c in q])
        n = max(k, efs) if self.rerank else k
        near = self.codes.select("id", distance(stored_vector, query, self.metric).alias("distance")).orderBy("distance", "id").limit(n)
        if not self.rerank:
            return near
        full = self.rows.join(F.broadcast(near.select("id")), "id")  # max(k, efs) rows
        return full.select("id", distance(F.col(self.column), literal(vector), self.metric).alias("distance")).orderBy("distance", "id").limit(k)


def quantize_vector(vector, quantization: str) -> tuple[list[float], float]:
    limit = QUANTIZATIONS[quantization]
    peak = max((abs(float(x)) for x in vector), default=0.0)
    scale = peak / limit if peak > 0 else 1.0
    return [max(-limit, min(limit, math.copysign(math.floor(abs(float(x) / scale) + 0.5), float(x)))) for x in vector], scale


def _coded(rows: DataFrame, column: str, quantization: str) -> DataFrame:
    codes, scale = quantize(F.col(column), quantization)
    return rows.select("id", codes.alias("codes"), scale.alias("scale"))


def quantized(
    rows: DataFrame, column: str, metric: str = "cosine", quantization: str = "sq8", rerank: bool = False, keep: bool = False
) -> QuantizedIndex:
    """Builds the codes of ``rows`` (``id`` and the vector column); null vectors are left out. ``keep`` stores them for many searches."""
    metric = metric_of(metric)
    if quantization not in QUANTIZATIONS or quantization == "none":
        raise ValueError("quantization must be sq8 or sq16.")
    if metric == "ip":
        raise ValueError("Quantization is not supported with dot product.")
    own = rows.where(F.col(column).isNotNull())
    paths: list[str] = []
    codes = _coded(own, column, quantization)
    return QuantizedIndex(stored(codes, "codes", paths) if keep else codes, own, column, metric, quantization, rerank, paths)


@dataclass(frozen=True)
class IvfIndex:
    """An inverted file: every row is in the list of its nearest centre; a search reads the lists of the nearest ``probes`` centres."""

    rows: DataFrame
    centres: list[list[float]]
    column: str
    metric: str
    #: Stored tables that go with the index.
    paths: list[str] = field(default_factory=list)

    def without(self, ids: DataFrame) -> IvfIndex:
        """The index after deleting the rows in ``ids`` (``id``)."""
        return self._with(self.rows.join(ids.select("id"), "id", "left_anti"))

    def with_rows(self, rows: DataFrame) -> IvfIndex:
        """The index after inserting or updating ``rows``, each into the list of its nearest centre; the centres stay."""
        own = rows.where(F.col(self.column).isNotNull()).withColumn("list", self.ranked(F.col(self.column))[0])
        return self._with(self.rows.join(rows.select("id"), "id", "left_anti").unionByName(own.select(*self.rows.columns)))

    def _with(self, rows: DataFrame) -> IvfIndex:
        paths: list[str] = []
        return replace(self, rows=_by_list(rows, paths) if self.paths else rows, paths=paths)

    def ranked(self, vector: Column) -> Column:
        """The numbers of all lists, the nearest centre first."""
        apart = [F.struct(distance(vector, literal(c), "l2sq").alias("d"), F.lit(i).alias("i")) for i, c in enumerate(self.centres)]
        return F.transform(F.array_sort(F.array(*apart)), lambda x: x["i"])

    def search_all(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """``query, id, distance`` for every row of ``queries`` (``query, vector``): of all rows those of its nearest lists count.

        Blocks of queries are scored as in ``knn_join``: with many lists asked, a matrix product over all rows costs less than pairs by list.
        """
        centres = np.asarray(self.centres)

        def find(names: list, q: np.ndarray) -> DataFrame:
            apart = np.stack([((centres - v) ** 2).sum(1) for v in q])
            asked = np.zeros(apart.shape, dtype=bool)
            np.put_along_axis(asked, np.argsort(apart, axis=1, kind="stable")[:, :probes], True, axis=1)
            return _nearest(self.rows, self.column, names, q, k, self.metric, asked)

        return _by_blocks(queries, k, 1024, find)

    def search(self, vector, k: int, probes: int = 8) -> DataFrame:
        """The k nearest of the probed lists; with fewer than k there, all lists are read."""
        q = np.asarray(vector, dtype=np.float64)
        order = np.argsort(((np.asarray(self.centres) - q) ** 2).sum(1), kind="stable")[:probes]
        near = knn(self.rows, self.column, vector, k, self.metric, F.col("list").isin([int(i) for i in order]))
        return near if near.count() == k else knn(self.rows, self.column, vector, k, self.metric)


def _by_list(rows: DataFrame, paths: list[str]) -> DataFrame:
    """Stores rows partitioned by ``list``, so that a search reads its lists' files alone."""
    path = shared_path(rows.sparkSession, "lists")
    rows.write.partitionBy("list").parquet(path)
    paths.append(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)


def ivf(rows: DataFrame, column: str, lists: int = 64, metric: str = "l2", sample: int = 50_000, seed: int = 42, keep: bool = False) -> IvfIndex:
    """Centres come from a k-means over at most ``sample`` rows; every row is then assigned. ``keep`` stores rows by list, which prunes the scan."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    own = rows.where(F.col(column).isNotNull())
    fit = own.orderBy(F.xxhash64(F.lit(seed), "id")).limit(sample).select(array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=15).fit(fit)
    centres = [c.tolist() for c in model.clusterCenters()]
    told = model.transform(own.withColumn("features", array_to_vector(F.col(column).cast("array<double>"))))
    own, paths = told.withColumnRenamed("prediction", "list").drop("features"), []
    return IvfIndex(_by_list(own, paths) if keep else own, centres, column, metric_of(metric), paths)
