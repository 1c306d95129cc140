from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.graph import GraphCatalogue
from graphloom.plans.gql import GqlError, GqlSession


@pytest.fixture
def session(spark):
    c = GraphCatalogue()
    c.add_nodes("Person", spark.createDataFrame([(i, f"p{i}", 20 + i % 2) for i in range(1, 6)], "id long, name string, age long"))
    c.add_nodes("Org", spark.createDataFrame([(1, "Acme")], "id long, name string"))
    c.add_edges("KNOWS", "Person", "Person", spark.createDataFrame([(i, i + 1, 2000 + i) for i in range(1, 5)], "src long, dst long, since long"))
    c.add_edges("WORKS_AT", "Person", "Org", spark.createDataFrame([(1, 1)], "src long, dst long"))
    return GqlSession(spark, c)


def rows(session, text):
    return [tuple(r) for r in session.run(text).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MATCH (n:Person) RETURN n.name AS name, n.age AS age ORDER BY n.age DESC, name LIMIT 2", [("p1", 21), ("p3", 21)]),
        ("SELECT n.age AS age, count(*) AS c FROM main MATCH (n:Person) HAVING count(*) > 2", [(21, 3)]),
        ("MATCH (p:Person) (()-[k:KNOWS]->()){3} (q:Person) RETURN p.name AS p, q.name AS q, size(k) AS hops ORDER BY p", [("p1", "p4", 3), ("p2", "p5", 3)]),
        ("MATCH (p:Person) (()-[:KNOWS]->()<-[:KNOWS]-()){1,2} (q:Person) WHERE p.id = 2 RETURN q.id AS q", [(2,), (2,)]),
        ("MATCH TRAIL (a:Person {id: 1})-[:KNOWS]->*(b:Person) RETURN count(*) AS c", [(5,)]),
        ("MATCH (a:Person)-[k:KNOWS]->(b:Person) MATCH (c:Person)-[k:KNOWS]->(d:Person) WHERE a.id = 2 RETURN c.id AS c, d.id AS d", [(2, 3)]),
        ("MATCH (a:Person)-[w:WORKS_AT]->(o:Org) RETURN a.name AS p, o.name AS o", [("p1", "Acme")]),
        ("MATCH (a:Person) OPTIONAL MATCH (a)-[:WORKS_AT]->(o:Org) RETURN count(o.id) AS n, count(*) AS all", [(1, 5)]),
        ("MATCH p = ALL SHORTEST (a:Person {id: 1})-[:KNOWS]->+(b:Person) RETURN b.id AS b, PATH_LENGTH(p) AS l ORDER BY b", [(2, 1), (3, 2), (4, 3), (5, 4)]),
        ("MATCH TRAIL (a:Person {id: 3})-[:KNOWS]-{2}(b:Person) RETURN b.id AS b ORDER BY b", [(1,), (5,)]),
        ("MATCH (a:Person)-[k:KNOWS WHERE k.since > 2002]->(b) RETURN k.since AS s ORDER BY s", [(2003,), (2004,)]),
        ("MATCH (a) WHERE a IS LABELED Org RETURN a.name AS n", [("Acme",)]),
        ("MATCH (a:!Person) RETURN a.name AS n", [("Acme",)]),
        ("MATCH (n:Person) RETURN DISTINCT n.age AS a ORDER BY a", [(20,), (21,)]),
        ("MATCH (n:Person) FILTER n.id > 3 RETURN count(*) AS c", [(2,)]),
        ("MATCH (n:Person) WHERE n.id IN [2, 4, 77] AND NOT n.name IN ['p4'] RETURN n.id AS id", [(2,)]),
        ("MATCH (n:Person {id: 2}) RETURN CAST(n.age AS STRING) IS NULL AS unknown, n.id AS id", [(False, 2)]),
    ],
)
def test_queries(session, text, want):
    assert rows(session, text) == want


def test_mixed_values_follow_the_total_order(spark):
    texts = ["3", "null", '"b"', "true", "[1]", "12345678901234567.125", None]
    c = GraphCatalogue()
    nodes = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    c.add_nodes("V", nodes.withColumn("v", F.parse_json("text")))
    c.add_nodes("O", spark.createDataFrame([(1, "{}")], "id long, text string"))
    s = GqlSession(spark, c)
    assert rows(s, "MATCH (n:V) RETURN to_json(MIN(n.v)) AS low, to_json(max(n.v)) AS high, count(n.v) AS n, max(n.id) AS i") == [("true", "12345678901234567.125", 6, 6)]
    assert rows(s, "MATCH (n:V) WHERE n.id IN [0, 1, 5] RETURN CAST(sum(n.v) AS STRING) AS s") == [("12345678901234570.1250000000",)]
    assert [r[0] for r in rows(s, "MATCH (n:V) RETURN n.id AS id ORDER BY n.v")] == [6, 1, 3, 4, 2, 0, 5]
    assert [r[0] for r in rows(s, "MATCH (n:V) WHERE _GQL_LT(n.text, '3') RETURN n.id AS id ORDER BY id")] == [1, 2, 3, 4]
    assert rows(s, "MATCH (n:V) WHERE _GQL_EQ(n.text, '3.0') RETURN _GQL_SORTKEY(n.text) = _GQL_SORTKEY('3.00') AS same") == [(True,)]
    for text, why in (
        ("MATCH (n:O) RETURN _GQL_SORTKEY(n.text) AS k", "objects"),
        ("MATCH (n:V) RETURN sum(n.v) AS s", "CAST"),
        ("MATCH (n:V) RETURN _GQL_LIST_CHECKED('[1, true]') AS l", "mixes types"),
    ):
        with pytest.raises(Exception, match=why):
            rows(s, text)
    with pytest.raises(GqlError):
        s.run("MATCH (n:V) RETURN _GQL_LT(n.text) AS x")


def test_unnamed_columns_keep_their_text(session):
    assert session.run("MATCH (n:Person) RETURN max(n.id)").columns == ["max(n.id)"]


def test_changes(session):
    session.run("INSERT (n:Person {id: 9, name: 'Zed', age: 1})")
    session.run("MATCH (n:Person {id: 9}) SET n.age = n.age + 41, n.name = 'Ann'")
    session.run("MATCH (a:Person {id: 9}), (b:Person {id: 1}) INSERT (a)-[:KNOWS {since: 1}]->(b)")
    assert rows(session, "MATCH (n:Person {id: 9})-[k:KNOWS]->(m) RETURN n.age, n.name, m.name, k.since") == [(42, "Ann", "p1", 1)]
    session.run("MATCH (n:Person {id: 9}) REMOVE n.name")
    assert rows(session, "MATCH (n:Person {id: 9}) RETURN n.name AS x") == [(None,)]
    with pytest.raises(GqlError):
        session.run("MATCH (n:Person {id: 9}) DELETE n")
    session.run("MATCH (n:Person {id: 9}) DETACH DELETE n")
    assert rows(session, "MATCH (n:Person)-[k:KNOWS]->() RETURN count(*) AS c") == [(4,)]


def test_catalogue(session):
    session.run("CREATE GRAPH g ANY")
    with pytest.raises(GqlError):
        session.run("CREATE GRAPH g ANY")
    session.run("CREATE GRAPH IF NOT EXISTS g ANY")
    session.run("CREATE SCHEMA /a/b")
    assert session.schemas() == ["/", "/a/b"]
    session.run("SESSION SET GRAPH g")
    session.run("INSERT (a:\"My Label\" {name: 'x'})-[:TIES {w: 2}]->(b:Other {size: 1})")
    session.run("INSERT (a:Other {size: 'large', more: 1.5})")
    assert rows(session, "MATCH (a)-[t:TIES]->(b:Other) RETURN a.name, t.w, b.size") == [("x", 2, "1")]
    assert rows(session, "MATCH (b:Other) RETURN b.id, b.size, b.more ORDER BY b.id")[1][:2] == (2, "large")
    session.run("DROP GRAPH g")


@pytest.mark.parametrize(
    "text",
    [
        "LET old = 60 RETURN old", "MATCH (p:Person) RETURN p.age UNION MATCH (o:Org) RETURN o.id", "MATCH (p:Person) RETURN p.name NEXT RETURN 2", "MERGE (o:Org {id: 4})",
        "MATCH ALL PATHS (p)-[]->(q) RETURN q", "MATCH SHORTEST 3 (p)-[]->(q) RETURN q", "SELECT DISTINCT sum(p.age) AS s FROM main MATCH (p:Person)",
        "FOR part IN ['nut', 4] RETURN part", "FETCH ME (p:Person", " ", "MATCH (r:Robot) RETURN r", "MATCH (p:Person) RETURN p.name GROUP BY ()",
        "CREATE OR REPLACE GRAPH h ANY", "MATCH (p:Person)-[:KNOWS]->*(q:Person) RETURN q.id",
    ],
)
def test_refusals(session, text):
    with pytest.raises(GqlError):
        session.run(text)


def test_shortest_paths_have_no_longest(spark):
    n = 40
    c = GraphCatalogue()
    c.add_nodes("Stop", spark.range(n))
    c.add_edges("LINE", "Stop", "Stop", spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst"))
    got = rows(GqlSession(spark, c), "MATCH p = ANY SHORTEST (a:Stop {id: 0})-[:LINE]->+(b:Stop) RETURN max(PATH_LENGTH(p)) AS l, count(*) AS c")
    assert got == [(n - 1, n - 1)]


def test_explain_and_keys(session):
    plan = session.run("EXPLAIN MATCH (n:Person) RETURN n.name AS name")
    assert plan.columns == ["plan"] and "Project" in plan.first()["plan"]
    with pytest.raises(GqlError):
        session.run("EXPLAIN INSERT (n:Person {id: 70})")
    with pytest.raises(GqlError):
        session.run("INSERT (n:Person {id: 3, name: 'again'})")
    assert rows(session, "MATCH (n:Person) RETURN count(*) AS c") == [(5,)]
