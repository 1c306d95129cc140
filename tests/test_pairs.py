from __future__ import annotations

import pytest

from graphloom.graph import GraphCatalogue
from graphloom.plans.gql import GqlSession, Parser


@pytest.fixture(scope="module")
def session(spark):
    c = GraphCatalogue()
    c.add_nodes("P", spark.createDataFrame([(i, i % 7, None if i % 11 == 0 else i % 5) for i in range(60)], "id long, w long, v long"))
    c.add_nodes("N", spark.createDataFrame([(i, "ab"[i % 2]) for i in range(4)], "id long, name string"))
    c.add_edges("IN", "P", "N", spark.createDataFrame([(i, i % 3, i) for i in range(60)] + [(i, 1, 60 + i) for i in range(0, 60, 4)], "src long, dst long, rel long"))
    return GqlSession(spark, c)


@pytest.mark.parametrize("tie", ["a.id < b.id", "a.v <= b.v", "b.v < a.v AND b.w > 2", "a.v >= b.v AND n.name = 'a'", "a.w > 3 AND b.w < 3"])
def test_pairs_are_counted_without_being_made(session, monkeypatch, tie):
    text = f"MATCH (a:P)-[:IN]->(n:N)<-[:IN]-(b:P) WHERE {tie} RETURN count(*) AS pairs, n.name AS name"
    assert session._counted_pairs(Parser(text)) is not None
    got = session.run(text)
    monkeypatch.setattr(GqlSession, "_counted_pairs", lambda self, p: None)
    want = session.run(text)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("rest", ["WHERE a.id < b.id OR a.v = 1 RETURN n.name AS name, count(*) AS n", "RETURN n.name AS name, count(DISTINCT a.id) AS n", "RETURN count(*) AS n"])
def test_other_statements_are_read_from_their_start(session, rest):
    p = Parser(f"MATCH (a:P)-[:IN]->(n:N)<-[:IN]-(b:P) {rest}")
    assert session._counted_pairs(p) is None and p.i == 0
