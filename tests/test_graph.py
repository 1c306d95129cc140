from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from graphloom.graph import GraphCatalogue, GraphError, ProjectedGraph, register_from_tables
from graphloom.operators import centrality, community, embedding, forest, paths
from graphloom.operators.components import components
from graphloom.storage import stored


def graph(spark, n, edges):
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    kind = "src long, dst long, rel long" + (", weight long" if edges and len(edges[0]) > 2 else "")
    return ProjectedGraph(nodes, spark.createDataFrame([(a, b, i, *w) for i, (a, b, *w) in enumerate(edges)], kind))


def scores(df):
    return {r[0]: round(r[1], 6) for r in df.collect()}


@pytest.fixture(scope="module")
def star(spark):
    return graph(spark, 4, [(1, 0), (2, 0), (3, 0)])


@pytest.fixture(scope="module")
def cliques(spark):
    return graph(spark, 8, [(a, b) for o in (0, 4) for a, b in itertools.combinations(range(o, o + 4), 2)] + [(3, 4)])


def test_star_scores(star):
    assert scores(centrality.degree(star)) == {0: 3, 1: 1, 2: 1, 3: 1}
    assert scores(centrality.degree(star, True))[0] == 0.75
    assert scores(centrality.closeness(star)) == {0: 1.0, 1: 0.6, 2: 0.6, 3: 0.6}
    assert scores(centrality.harmonic(star))[1] == 0.666667
    assert scores(centrality.eigenvector(star)) == {0: 0.866025, 1: 0.288675, 2: 0.288675, 3: 0.288675}
    assert scores(centrality.betweenness(star)) == {0: 6, 1: 0, 2: 0, 3: 0}
    assert scores(community.core_number(star, True)) == {i: 0.333333 for i in range(4)}


def test_eigenvector_matches_dense_power_iteration(spark):
    rng = random.Random(5)
    edges = [(0, 1), (1, 2), (2, 0)] + [(rng.randrange(i), i) for i in range(3, 40)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(60)]
    near = np.zeros((41, 41))  # the last node stands alone
    for a, b in edges:
        if a != b:
            near[a, b] = near[b, a] = 1
    want = np.abs(np.linalg.eigh(near)[1][:, -1])
    got = {r[0]: r[1] for r in centrality.eigenvector(graph(spark, 41, edges), 1e-12).collect()}
    assert len(got) == 41 and max(abs(got[i] - want[i]) for i in range(41)) < 1e-5
    assert scores(centrality.eigenvector(graph(spark, 2, [(0, 0)]))) == {0: 0, 1: 0}


def test_page_rank_counts_its_first_value_and_loses_dangling_mass(spark):
    g = graph(spark, 8, [(0, 1), (0, 2), (3, 4)])
    got = scores(centrality.page_rank(g))
    assert got[0] == 0.01875 and got[1] == 0.026719
    with pytest.raises(GraphError):
        centrality.page_rank(g, damping=1.0)
    with pytest.raises(GraphError):
        centrality.page_rank(g, max_iterations=0)


def test_communities_of_two_cliques(cliques):
    for found in (community.louvain(cliques), community.leiden(cliques), community.label_propagation(cliques), community.cut_clustering(cliques, 0.3)):
        groups = {r[0]: r[1] for r in found.collect()}
        assert len({groups[i] for i in range(4)}) == 1 and len({groups[i] for i in range(4, 8)}) == 1 and groups[0] != groups[4]
    assert {r["coreness"] for r in community.steiner_core(cliques, [0, 1]).collect()} == {3}


def test_isolated_nodes_and_loops(spark):
    g = graph(spark, 4, [(0, 0), (0, 1)])
    assert scores(community.k_core(g))[3] == 0
    assert scores(community.weakly_connected(g)) == {0: 0, 1: 0, 2: 2, 3: 3}
    assert scores(community.louvain(g))[2] == 2


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_components_are_numbered_in_order(spark):
    g = graph(spark, 300, [(i, i + 1) for i in range(0, 300, 3)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scores(community.numbered_components(g))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    least = [i for i in range(300) if i % 3 != 1]
    assert got == {i: least.index(i - (i % 3 == 1)) for i in range(300)}
    assert community.numbered_components(graph(spark, 0, [])).count() == 0


def test_core_numbers_match_peeling(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(20), rng.randrange(20)) for _ in range(60)]
    near = {i: [] for i in range(20)}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    left, core, k = set(near), {}, 0
    while left:
        low = [v for v in left if sum(w in left for w in near[v]) <= k]
        if not low:
            k += 1
            continue
        for v in low:
            core[v] = k
        left -= set(low)
    assert scores(community.k_core(graph(spark, 20, edges))) == core


def test_strong_components(spark):
    got = scores(community.strongly_connected(graph(spark, 5, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3)])))
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}


def test_spanning_forest(spark):
    g = graph(spark, 7, [(0, 1, 5), (1, 2, 3), (2, 0, 1), (3, 4, 7), (4, 5, 2), (5, 3, 9), (6, 6, 1)])
    low = forest.spanning_forest(g, "min", "weight").collect()
    assert {r["rel"] for r in low} == {1, 2, 3, 4} and {r["forest_id"] for r in low} == {0, 3}
    assert {r["rel"] for r in forest.spanning_forest(g, "max", "weight").collect()} == {0, 1, 3, 5}
    with pytest.raises(GraphError):
        forest.spanning_forest(g, "min", "nothing")


def test_distances(spark):
    g = graph(spark, 4, [(0, 1, 5), (1, 2, 1), (0, 2, 9)])
    assert scores(paths.bfs_distance(g, 0)) == {0: 0, 1: 1, 2: 1, 3: -1}
    assert scores(paths.weighted_distance(g, 0, "weight")) == {0: 0, 1: 5, 2: 6}
    with pytest.raises(GraphError):
        paths.bfs_distance(g, 99)


def test_path_modes(spark):
    edges = graph(spark, 3, [(0, 1), (1, 2), (2, 0)]).edges
    count = lambda mode: paths.walks(edges, 1, 4, mode).count()
    assert (count("WALK"), count("TRAIL"), count("ACYCLIC"), count("SIMPLE")) == (12, 9, 6, 9)
    assert paths.walks(edges, 0, 0).count() == 3


def test_node2vec_shape(star):
    rows = embedding.node2vec(star, dimensions=8).collect()
    assert sorted(r["id"] for r in rows) == [0, 1, 2, 3] and all(len(r["embedding"]) == 8 for r in rows)


def test_catalogue(spark):
    c = GraphCatalogue()
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    c.add_nodes("N1", df)
    c.add_nodes("N2", df)
    c.add_edges("R", "N1", "N2", spark.createDataFrame([(1, 2)], "src long, dst long"))
    with pytest.raises(GraphError, match="N2 is connected to R but not projected"):
        c.project("G", ["N1"], ["R"])
    c.project("G", ["N1", "N2"], ["R"])
    with pytest.raises(GraphError):
        c.project("G", ["N1", "N2"], ["R"])
    c.drop_projected("G")
    graph_, skipped = register_from_tables(
        {"node_person": df, "rel_knows": spark.createDataFrame([(1, 2)], "src_id long, dst_id long"), "other": df, "rel_bad": df}
    )
    assert list(graph_.edge_tables) == ["knows"] and set(skipped) == {"other", "rel_bad"}
