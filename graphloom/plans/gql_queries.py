"""GQL statements over rings of customers and over changed graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..graph import GraphCatalogue
from .catalogue import register
from .engine_queries import commerce
from .gql import GqlSession
from .graph_queries import RING_SQL, ring_graph


def rings(spark: SparkSession, sf_dir: str) -> GqlSession:
    g, c = ring_graph(spark, sf_dir), GraphCatalogue()
    c.add_nodes("Member", g.nodes)
    c.add_edges("KNOWS", "Member", "Member", g.edges)
    return GqlSession(spark, c)


def _ring(name: str, text: str, sql: str) -> None:
    register(name, f"WITH RECURSIVE {RING_SQL}{sql}")(lambda spark, sf_dir: rings(spark, sf_dir).run(text))


_ring(
    "gql_either_way",
    "MATCH (a:Member)-[k:KNOWS]-(b:Member) RETURN a.id AS a, count(*) AS n, sum(k.weight) AS weight",
    ", u AS (SELECT src, weight FROM rg UNION ALL SELECT dst, weight FROM rg) SELECT src AS a, count(*) AS n, sum(weight)::BIGINT AS weight FROM u GROUP BY src",
)
_ring(
    "gql_quantified",
    "MATCH (a:Member)-[:KNOWS]->{2,3}(b:Member) RETURN a.id AS a, b.id AS b, count(*) AS n",
    """, two AS (SELECT x.src, y.dst FROM rg x JOIN rg y ON y.src = x.dst), three AS (SELECT t.src, z.dst FROM two t JOIN rg z ON z.src = t.dst)
SELECT src AS a, dst AS b, count(*) AS n FROM (FROM two UNION ALL FROM three) GROUP BY ALL""",
)
_ring(
    "gql_repeated_group",
    "MATCH (a:Member) (()-[:KNOWS]->()<-[:KNOWS]-()){1,2} (b:Member) RETURN a.id AS a, b.id AS b, count(*) AS n",
    """, one AS (SELECT x.src, y.src AS dst FROM rg x JOIN rg y ON y.dst = x.dst), two AS (SELECT p.src, q.dst FROM one p JOIN one q ON q.src = p.dst)
SELECT src AS a, dst AS b, count(*) AS n FROM (FROM one UNION ALL FROM two) GROUP BY ALL""",
)
_ring(
    "gql_trail",
    "MATCH TRAIL (a:Member)-[:KNOWS]-{3}(b:Member) RETURN a.id AS a, count(*) AS n",
    """, d AS (SELECT src, dst, src || '>' || dst AS rel FROM rg UNION ALL SELECT dst, src, src || '>' || dst FROM rg)
SELECT x.src AS a, count(*) AS n FROM d x JOIN d y ON y.src = x.dst AND y.rel <> x.rel JOIN d z ON z.src = y.dst AND z.rel <> y.rel AND z.rel <> x.rel GROUP BY x.src""",
)
_ring(
    "gql_acyclic",
    "MATCH ACYCLIC (a:Member)-[:KNOWS]->{1,4}(b:Member) RETURN a.id AS a, b.id AS b, count(*) AS n",
    """, w AS (SELECT src, dst, [src, dst] AS seen, 1 AS n FROM rg UNION ALL SELECT w.src, rg.dst, list_append(seen, rg.dst), n + 1 FROM w JOIN rg ON rg.src = w.dst
  WHERE n < 4 AND NOT list_contains(seen, rg.dst)) SELECT src AS a, dst AS b, count(*) AS n FROM w GROUP BY ALL""",
)
_ring(
    "gql_any_shortest",
    "MATCH p = ANY SHORTEST (a:Member)-[:KNOWS]->{1,12}(b:Member) WHERE a.id <> b.id RETURN a.id AS a, b.id AS b, PATH_LENGTH(p) AS hops",
    """, w AS (SELECT src, dst, 1 AS n FROM rg UNION SELECT w.src, rg.dst, n + 1 FROM w JOIN rg ON rg.src = w.dst WHERE n < 12)
SELECT src AS a, dst AS b, min(n)::INTEGER AS hops FROM w WHERE src <> dst GROUP BY ALL""",
)
_ring(
    "gql_inline_edge_filter",
    "MATCH (a:Member)-[x:KNOWS WHERE x.weight > 4]->(b:Member)-[y:KNOWS {weight: 3}]->(c:Member) RETURN a.id AS a, c.id AS c",
    " SELECT x.src AS a, y.dst AS c FROM rg x JOIN rg y ON y.src = x.dst WHERE x.weight > 4 AND y.weight = 3",
)


def _commerce(name: str, texts: list[str], sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = commerce(spark, sf_dir)
        for text in texts[:-1]:
            session.run(text)
        return session.run(texts[-1])

    register(name, sql)(query)


_commerce(
    "gql_set_delete_insert",
    [
        "MATCH (c:Customer WHERE c.balance < 0) SET c.balance = 0.0",
        "MATCH (c:Customer WHERE c.balance > 9000) DETACH DELETE c",
        "INSERT (c:Customer {id: -1, name: 'New', balance: 5.5})",
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) RETURN c.id AS id, c.name AS name, c.balance AS balance, count(o.id) AS orders",
    ],
    """SELECT c_custkey AS id, c_name AS name, greatest(c_acctbal, 0.0) AS balance, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey
       WHERE c_acctbal <= 9000 GROUP BY ALL UNION ALL SELECT -1, 'New', 5.5, 0""",
)
_commerce(
    "gql_remove",
    ["MATCH (c:Customer WHERE c.balance < 1000) REMOVE c.name", "MATCH (c:Customer) WHERE c.name IS NULL RETURN c.id AS id, COALESCE(c.name, 'none') AS name"],
    "SELECT c_custkey AS id, 'none' AS name FROM customer WHERE c_acctbal < 1000",
)
_commerce(
    "gql_aggregates",
    ["MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer) RETURN n.name AS nation, min(c.balance) AS least, max(c.name) AS last, count(DISTINCT c.balance) AS balances, PERCENTILE_CONT(c.balance, 0.5) AS middle"],
    """SELECT n_name AS nation, min(c_acctbal) AS least, max(c_name) AS last, count(DISTINCT c_acctbal) AS balances, quantile_cont(c_acctbal, 0.5) AS middle
       FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""",
)
_commerce(
    "gql_functions",
    ["MATCH (c:Customer) RETURN c.id AS id, CHAR_LENGTH(c.name) AS n, UPPER(c.name) AS up, CASE WHEN c.balance < 0 THEN 'debt' ELSE 'credit' END AS side, CAST(c.balance AS STRING) IS NOT NULL AS told"],
    """SELECT c_custkey AS id, length(c_name)::INTEGER AS n, upper(c_name) AS up, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side, c_acctbal IS NOT NULL AS told FROM customer""",
)
