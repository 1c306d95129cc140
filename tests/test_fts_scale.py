from __future__ import annotations

import time

import pandas as pd

from graphloom.functions.stem import _stemmed
from graphloom.operators import fts


def test_a_batch_costs_no_more_when_many_words_are_known():
    """Before, each batch turned over all words known so far."""
    first, small = pd.Series([f"w{i}" for i in range(400_000)]), pd.Series(["w1", "w2", None])
    batches = _stemmed(iter([first] + [small] * 200), lambda w: w)
    next(batches)
    start = time.perf_counter()
    assert all(list(b) == ["w1", "w2", None] for b in batches)
    assert time.perf_counter() - start < 5


def test_postings_are_shuffled_once_before_their_ranges(spark):
    docs = spark.createDataFrame([(i % 30, f"alpha beta{i % 7} beta{i % 7} running") for i in range(60)], "id long, body string")
    plan = lambda kind: fts._postings(docs, ["body"], fts.FtsConfig(stemmer=kind))._jdf.queryExecution().executedPlan().toString()
    # the texts are dealt, and stems once more; before, the words were too, and lengths came from postings in ranges of terms
    assert plan("none").count("Exchange hashpartitioning(id") == 1 and "REPARTITION_BY_COL" in plan("none")
    index = fts.build(docs, ["body"])
    assert {r["tf"] for r in index.postings.where("term = 'run'").collect()} == {2} and index.lengths.agg({"len": "sum"}).first()[0] == 240
