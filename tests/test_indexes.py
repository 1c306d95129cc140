from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from graphloom.graph import GraphCatalogue, GraphError
from graphloom.operators import fts, indexes, vectors


@pytest.fixture
def shelf(spark):
    c = GraphCatalogue()
    rows = [(i, text, [float(i), 1.0, float(i % 3)]) for i, text in enumerate(["red fox", "blue whale", "red whales", None, "green frog", "red ant"])]
    c.add_nodes("Card", spark.createDataFrame(rows, "id long, body string, vec array<float>"))
    return c


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_text_index(spark, shelf):
    indexes.create_fts_index(shelf, "Card", "words", ["body"])
    assert shelf.show_indexes() == [("Card", "words", "FTS")]
    ask = lambda text: ids(indexes.query_fts_index(shelf, "Card", "words", text))
    assert ask("whale") == [1, 2] and ask("red") == [0, 2, 5]
    indexes.put_rows(shelf, "Card", spark.createDataFrame([(1, "brown bear", [0.0, 0.0, 0.0]), (9, "blue whale", [9.0, 9.0, 9.0])], "id long, body string, vec array<float>"))
    assert ask("whale") == [2, 9] and ask("bears") == [1]
    indexes.delete_rows(shelf, "Card", spark.createDataFrame([(2,)], "id long"))
    assert ask("whale") == [9] and shelf.node_tables["Card"].count() == 6
    paths = [p.removeprefix("file://") for p in shelf.index("Card", "words", "FTS")[0].paths]
    assert paths and all(Path(p).is_dir() for p in paths)
    indexes.drop_fts_index(shelf, "Card", "words")
    assert shelf.show_indexes() == [] and not any(Path(p).exists() for p in paths)


def test_query_words_are_stemmed_as_the_index_is(spark):
    docs = spark.createDataFrame([(0, "generously"), (1, "generous")], "id long, body string")
    index = fts.build(docs, ["body"], fts.FtsConfig(stemmer="porter"))
    assert ids(fts.query(index, "generously")) == [0, 1]


@pytest.mark.parametrize("quantization", ["none", "sq8", "sq16"])
def test_vector_index(spark, shelf, quantization):
    indexes.create_vector_index(shelf, "Card", "near", "vec", "l2", quantization, lists=2)
    ask = lambda k, **more: [r["id"] for r in indexes.query_vector_index(shelf, "Card", "near", [0.0, 1.0, 0.0], k, **more).collect()]
    assert ask(1) == [0] and len(ask(6)) == 6
    indexes.put_rows(shelf, "Card", spark.createDataFrame([(0, "x", [90.0, 1.0, 0.0]), (8, "y", [0.0, 1.0, 0.0]), (7, "z", None)], "id long, body string, vec array<float>"))
    assert ask(1) == [8] and sorted(ask(9)) == [0, 1, 2, 3, 4, 5, 8]
    indexes.delete_rows(shelf, "Card", spark.createDataFrame([(8,)], "id long"))
    assert 8 not in ask(9)
    indexes.drop_vector_index(shelf, "Card", "near")
    assert shelf.show_indexes() == []


def test_names(shelf):
    with pytest.raises(GraphError):
        indexes.create_fts_index(shelf, "Nobody", "i", ["body"])
    with pytest.raises(GraphError):
        indexes.create_fts_index(shelf, "Card", "i", ["nothing"])
    indexes.create_fts_index(shelf, "Card", "i", ["body"])
    with pytest.raises(GraphError):
        indexes.create_vector_index(shelf, "Card", "i", "vec", lists=2)
    with pytest.raises(GraphError):
        indexes.drop_vector_index(shelf, "Card", "i")
    with pytest.raises(GraphError):
        indexes.query_fts_index(shelf, "Card", "j", "red")


def test_knn_join_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    points = rng.random((90, 4))
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(90, None)], "id long, v array<double>")
    queries = spark.createDataFrame([(i, points[i].tolist()) for i in range(0, 90, 3)] + [(90, None)], "query long, vector array<double>")
    want = {(q, i) for q in range(0, 90, 3) for i in np.argsort(((points - points[q]) ** 2).sum(1), kind="stable")[:3].tolist()}
    for block, kept in ((1000, 16), (7, 16), (4, 2)):
        monkeypatch.setattr(vectors, "STORED_BLOCKS", kept)
        assert {(r["query"], r["id"]) for r in vectors.knn_join(queries, rows, "v", 3, "l2", block).collect()} == want
    assert vectors.knn_join(queries.limit(0), rows, "v", 3).count() == 0
