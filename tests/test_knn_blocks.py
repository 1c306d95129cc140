from __future__ import annotations

import numpy as np
import pytest

from graphloom.operators import vectors


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate((rng.random((60, 4)), rng.random((10, 4)).repeat(3, 0)))  # some three times
    return values, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "id long, v array<double>").repartition(3)


def nearest(values, own, k, among):
    d = np.sqrt(((values - values[own]) ** 2).sum(1))
    return {(own, int(i)) for i in sorted(among, key=lambda i: (round(d[i], 9), i))[:k]}


def test_rows_are_scored_a_few_at_a_time(points, monkeypatch):
    monkeypatch.setattr(vectors, "SCORED_ROWS", 4)  # before, a whole batch at once
    values, rows = points
    queries = rows.where("id % 7 = 0").selectExpr("id AS query", "v AS vector")
    want = set().union(*[nearest(values, q, 5, range(90)) for q in range(0, 90, 7)])
    assert {(r["query"], r["id"]) for r in vectors.knn_join(queries, rows, "v", 5, "l2").collect()} == want


def test_search_of_many_queries_reads_their_lists_alone_and_joins_nothing(points):
    values, rows = points
    index = vectors.ivf(rows, "v", lists=4)
    queries = rows.where("id % 7 = 0").selectExpr("id AS query", "v AS vector")
    found = index.search_all(queries, 5, probes=2)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # before, every query met every row of its lists in a join
    lists = {r["id"]: r["list"] for r in index.rows.select("id", "list").collect()}
    want = set()
    for q in range(0, 90, 7):
        read = np.argsort(((np.asarray(index.centres) - values[q]) ** 2).sum(1), kind="stable")[:2]
        want |= nearest(values, q, 5, [i for i in range(90) if lists[i] in read])
    assert {(r["query"], r["id"]) for r in found.collect()} == want
