from __future__ import annotations

import random
import uuid

import pytest

from graphloom.graph import ProjectedGraph
from graphloom.operators import centrality, community, paths, pieces
from graphloom.storage import Loop

from .test_graph import scores

JOBS = 60


def jobs(spark, query):
    """How many jobs a query takes, with its rows."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        rows = query().collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), {tuple(r) for r in rows}


def graph(spark, edges, n):
    return ProjectedGraph(spark.range(n).toDF("id"), spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "src long, dst long, rel long"))


@pytest.fixture(scope="module")
def mixed(spark):
    """Rings tied by bridges, a denser random component, loops, parallel edges and nodes alone."""
    rng = random.Random(7)
    edges = [(8 * r + i, 8 * r + (i + 1) % 8) for r in range(12) for i in range(8)] + [(16 * r, 16 * r + 8) for r in range(6)]
    edges += [(rng.randrange(100, 130), rng.randrange(100, 130)) for _ in range(70)] + [(140, 140), (141, 142), (141, 142)]
    return graph(spark, edges, 150)


@pytest.fixture
def whole(monkeypatch):
    """No component fits a piece: everything goes by rounds over the cluster."""

    def on():
        monkeypatch.setattr(pieces, "PIECE_EDGES", 0)
        monkeypatch.setattr(pieces, "SHARED_EDGES", 1)

    return on


def test_louvain_and_leiden_take_few_jobs(spark, mixed):
    for operator in (community.louvain, community.leiden):
        assert jobs(spark, lambda f=operator: f(mixed))[0] < JOBS  # by rounds: hundreds


@pytest.mark.parametrize("refine", [False, True])
def test_louvain_in_pieces_is_that_of_the_rounds(mixed, whole, refine):
    got = scores(community.louvain(mixed, 2, 6, refine=refine))
    whole()
    assert got == scores(community.louvain(mixed, 2, 6, refine=refine))


OPERATORS = {
    "k_core": community.k_core,
    "core_number": community.core_number,
    "steiner_core": lambda g: community.steiner_core(g, [0, 9]),
    "strong": lambda g: community.strongly_connected(g, 20),
    "strong_whole": community.strongly_connected_kosaraju,
    "labels": lambda g: community.label_propagation(g, max_iterations=4),
    "bfs": lambda g: paths.bfs_distance(g, 3),
    "closeness": centrality.closeness,
    "harmonic": centrality.harmonic,
    "simple_page_rank": centrality.simple_page_rank,
    "personalised": lambda g: centrality.simple_page_rank(g, sources=[3, 149]),
    "katz": centrality.katz,
    "eigenvector": centrality.eigenvector,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_components_that_fit_a_task_take_no_rounds(mixed, monkeypatch, name):
    def never(*_):
        raise AssertionError("a round over the cluster")

    monkeypatch.setattr(Loop, "keep", never)
    assert len(scores(OPERATORS[name](mixed))) == (16 if name == "steiner_core" else 150)


@pytest.mark.parametrize("name", ["k_core", "labels", "strong", "closeness"])
def test_pieces_give_what_rounds_give(mixed, whole, name):
    got = scores(OPERATORS[name](mixed))
    whole()
    assert got == scores(OPERATORS[name](mixed))


def test_betweenness_ships_no_graph(mixed, monkeypatch):
    monkeypatch.setattr(centrality, "ADJACENCY_EDGES", 0)  # before, the whole graph went to every task or was refused
    assert scores(centrality.betweenness(mixed))[0] > 0
