"""Graph algorithms over the commerce tables.

The part graph has an edge from each part of an order to the order's next part by key, so parallel edges occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..graph import ProjectedGraph
from ..operators import centrality, community, embedding, forest, paths
from .catalogue import register, table

EDGE_SQL = """
pe AS MATERIALIZED (SELECT src, dst, rel FROM (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS dst, l_orderkey AS rel
  FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) WHERE dst IS NOT NULL),
pn AS MATERIALIZED (SELECT p_partkey AS id FROM part),
ps AS MATERIALIZED (SELECT src, dst FROM pe WHERE src <> dst UNION SELECT dst, src FROM pe WHERE src <> dst)"""


def part_graph(spark: SparkSession, sf_dir: str) -> ProjectedGraph:
    order = W.Window.partitionBy("l_orderkey").orderBy("l_partkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    edges = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.col("l_orderkey").alias("rel"))
    return ProjectedGraph(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), edges.where("dst IS NOT NULL"))


def region_graph(spark: SparkSession, sf_dir: str) -> ProjectedGraph:
    """Nations, tied to the nations of their region that come next by key: a forest-like small graph with weights."""
    order = W.Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    nation = table(spark, sf_dir, "nation")
    edges = nation.select(F.col("n_nationkey").cast("long").alias("src"), F.lead("n_nationkey").over(order).cast("long").alias("dst"), F.col("n_nationkey").cast("long").alias("rel"))
    edges = edges.where("dst IS NOT NULL").withColumn("weight", (F.col("src") * 7 + F.col("dst")) % 11)
    return ProjectedGraph(nation.select(F.col("n_nationkey").cast("long").alias("id")), edges)


REGION_SQL = """
re AS MATERIALIZED (SELECT *, (src * 7 + dst) % 11 AS weight FROM (SELECT n_nationkey::BIGINT AS src,
  lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::BIGINT AS dst FROM nation) WHERE dst IS NOT NULL)"""


def ring_graph(spark: SparkSession, sf_dir: str) -> ProjectedGraph:
    """Customers in rings of eight by key (each knows the next, the last the first), every second ring bridged to the one after: cycles, and growing."""
    ring = F.floor(F.col("c_custkey") / 8).cast("long")
    order = W.Window.partitionBy("ring").orderBy("id")
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ring.alias("ring"))
    first, nxt = F.first("id").over(W.Window.partitionBy("ring").orderBy("id")), F.lead("id").over(order)
    edges = own.select(F.col("id").alias("src"), F.coalesce(nxt, first).alias("dst")).where("src <> dst")
    bridge = own.groupBy("ring").agg(F.min("id").alias("src")).where("ring % 2 = 0")
    onto = own.groupBy("ring").agg(F.min("id").alias("dst")).withColumn("ring", F.col("ring") - 1)
    edges = edges.unionByName(bridge.join(onto, "ring").select("src", "dst"))
    edges = edges.withColumn("rel", F.col("src") * 4 + (F.col("dst") > F.col("src") + 7).cast("int")).withColumn("weight", (F.col("src") * 7 + F.col("dst")) % 11)
    return ProjectedGraph(own.select("id"), edges)


RING_SQL = """
rg AS MATERIALIZED (SELECT *, (src * 7 + dst) % 11 AS weight FROM (
  SELECT c_custkey AS src, coalesce(lead(c_custkey) OVER w, first_value(c_custkey) OVER w) AS dst, 'ring' AS kind FROM customer WINDOW w AS (PARTITION BY c_custkey // 8 ORDER BY c_custkey)
  UNION ALL SELECT a.id, b.id, 'bridge' FROM (SELECT c_custkey // 8 AS r, min(c_custkey) AS id FROM customer GROUP BY r) a
    JOIN (SELECT c_custkey // 8 AS r, min(c_custkey) AS id FROM customer GROUP BY r) b ON b.r = a.r + 1 WHERE a.r % 2 = 0) WHERE src <> dst)"""
_STRONG = """, reach AS (SELECT c_custkey AS id, c_custkey AS other FROM customer UNION SELECT id, dst FROM reach JOIN rg ON src = other)
SELECT a.id, min(a.other) AS group_id FROM reach a JOIN reach b ON b.id = a.other AND b.other = a.id GROUP BY a.id"""


@register(
    "graph_two_hops",
    """SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM nation JOIN customer ON c_nationkey = n_nationkey
       JOIN orders ON o_custkey = c_custkey GROUP BY n_name""",
)
def graph_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation <- customer <- orders, counted by nation: orders fold by customer before they meet the nations."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("p"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    hops = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return hops.groupBy("n_name").agg(F.sum("n").alias("orders"), F.round(F.sum("p"), 2).alias("total"))


def _ranks(steps: int, d: float) -> str:
    out = f""", pd AS MATERIALIZED (SELECT src, count(*) AS deg FROM pe GROUP BY src),
w AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE / any_value(deg) AS w FROM pe JOIN pd USING (src) GROUP BY src, dst),
r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM pn) AS rank FROM pn)"""
    for i in range(steps):
        out += f""", r{i + 1} AS MATERIALIZED (SELECT id, {1 - d} / (SELECT count(*) FROM pn) + {d} * coalesce(got, 0) AS rank FROM pn
  LEFT JOIN (SELECT dst AS id, sum(rank * w) AS got FROM w JOIN r{i} ON r{i}.id = src GROUP BY dst) USING (id))"""
    return out


@register("graph_page_rank", f"WITH {EDGE_SQL}{_ranks(19, 0.85)} SELECT id, round(rank, 9) AS rank FROM r19")
def graph_page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centrality.page_rank(part_graph(spark, sf_dir)).select("id", F.round("rank", 9).alias("rank"))


@register("graph_degree", f"WITH {EDGE_SQL} SELECT id, count(dst)::DOUBLE AS score FROM pn LEFT JOIN ps ON src = id GROUP BY id")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centrality.degree(part_graph(spark, sf_dir))


def _least(rounds: int) -> str:
    out = ", c0 AS MATERIALIZED (SELECT id, id AS g FROM pn)"
    for i in range(rounds):
        out += f""", c{i + 1} AS MATERIALIZED (SELECT c.id, least(c.g, coalesce(min(n.g), c.g)) AS g FROM c{i} c
  LEFT JOIN ps ON src = c.id LEFT JOIN c{i} n ON n.id = dst GROUP BY c.id, c.g)"""
    return out


@register("graph_weak_components", f"WITH {EDGE_SQL}{_least(20)} SELECT id, g AS group_id FROM c20")
def graph_weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.weakly_connected(part_graph(spark, sf_dir))


@register("graph_connected_components", f"WITH {EDGE_SQL}{_least(30)} SELECT id, dense_rank() OVER (ORDER BY g) - 1 AS component_id FROM c30")
def graph_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.numbered_components(part_graph(spark, sf_dir))


@register(
    "graph_bfs_distance",
    f"""WITH RECURSIVE {EDGE_SQL}, f AS (SELECT min(id) AS id, 0 AS d FROM pn UNION SELECT dst, d + 1 FROM f JOIN pe ON src = id WHERE d < 40)
    SELECT id, coalesce(d, -1)::DOUBLE AS distance FROM pn LEFT JOIN (SELECT id, min(d) AS d FROM f GROUP BY id) USING (id)""",
)
def graph_bfs_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = part_graph(spark, sf_dir)
    return paths.bfs_distance(graph, graph.nodes.agg(F.min("id").alias("id")).first()["id"])


def _cores(rounds: int) -> str:
    out = """, e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM pe UNION ALL SELECT dst, src FROM pe) GROUP BY ALL),
k0 AS MATERIALIZED (SELECT src AS id, sum(n)::BIGINT AS k FROM e GROUP BY src)"""
    for i in range(rounds):
        out += f""", k{i + 1} AS MATERIALIZED (SELECT src AS id, max(least(k, upto))::BIGINT AS k FROM (
  SELECT src, k, sum(sum(n)) OVER (PARTITION BY src ORDER BY k DESC) AS upto FROM e JOIN k{i} ON id = dst GROUP BY src, k) GROUP BY src)"""
    return out


@register("graph_k_core", f"WITH {EDGE_SQL}{_cores(40)} SELECT id, coalesce(k, 0) AS k_degree FROM pn LEFT JOIN k40 USING (id)")
def graph_k_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.k_core(part_graph(spark, sf_dir))


@register(
    "graph_spanning_forest",
    # rings have no chord: of each ring the edge that comes last in the order of weight and ends goes, bridges all stay
    f"""WITH {RING_SQL} SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src // 8, kind ORDER BY weight DESC, src DESC, dst DESC) AS n,
      count(*) OVER (PARTITION BY src // 8, kind) AS size FROM rg) WHERE kind = 'bridge' OR size < 3 OR n > 1""",
)
def graph_spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring graph's least forest by weight."""
    graph = ring_graph(spark, sf_dir)
    return forest.spanning_forest(graph, "min", "weight").join(graph.edges.select("rel", "weight"), "rel").select("src", "dst", "weight")


@register(
    "graph_weighted_distance",
    # a least path passes no node twice: it has at most 15 edges within two bridged rings
    f"""WITH RECURSIVE {RING_SQL}, f AS (SELECT (SELECT min(c_custkey) FROM customer) AS id, 0 AS c, 0 AS n
      UNION SELECT dst, c + weight, n + 1 FROM f JOIN rg ON src = id WHERE n < 15) SELECT id, min(c)::DOUBLE AS cost FROM f GROUP BY id""",
)
def graph_weighted_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = ring_graph(spark, sf_dir)
    return paths.weighted_distance(graph, graph.nodes.agg(F.min("id").alias("id")).first()["id"], "weight")


@register(
    "graph_trails",
    f"""WITH {RING_SQL}, e AS MATERIALIZED (SELECT *, row_number() OVER () AS nth FROM rg)
      SELECT a.src, b.dst, 2::BIGINT AS hops FROM e a JOIN e b ON b.src = a.dst WHERE a.nth <> b.nth
      UNION ALL SELECT a.src, c.dst, 3 FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst WHERE a.nth <> b.nth AND a.nth <> c.nth AND b.nth <> c.nth""",
)
def graph_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paths.walks(ring_graph(spark, sf_dir).edges, 2, 3, "TRAIL")
    return found.select("src", "dst", F.size("rels").cast("long").alias("hops"))


#: Two bridged rings of eight are at most nine edges across.
_REACH = f"""WITH RECURSIVE {RING_SQL}, both_ways AS MATERIALIZED (SELECT src, dst FROM rg UNION SELECT dst, src FROM rg),
f AS (SELECT src AS id, dst AS other, 1 AS d FROM both_ways UNION SELECT f.id, dst, d + 1 FROM f JOIN both_ways ON src = other WHERE d < 10),
s AS (SELECT id, other, min(d) AS d FROM f WHERE id <> other GROUP BY id, other), n AS (SELECT count(*) - 1 AS m FROM customer)
SELECT c_custkey AS id, """


@register("graph_closeness", _REACH + "round(coalesce(any_value(m) / sum(d), 0), 9) AS score FROM customer CROSS JOIN n LEFT JOIN s ON id = c_custkey GROUP BY c_custkey")
def graph_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centrality.closeness(ring_graph(spark, sf_dir)).select("id", F.round("score", 9).alias("score"))


@register("graph_harmonic", _REACH + "round(coalesce(sum(1.0 / d), 0) / any_value(m), 9) AS score FROM customer CROSS JOIN n LEFT JOIN s ON id = c_custkey GROUP BY c_custkey")
def graph_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centrality.harmonic(ring_graph(spark, sf_dir)).select("id", F.round("score", 9).alias("score"))


def _restarted(restart: str) -> str:
    """The walk with restarts: a round is made of the one before until ranks move by less than 1e-7 in all."""
    return f"""WITH RECURSIVE {EDGE_SQL}, deg AS MATERIALIZED (SELECT src, count(*) AS deg FROM ps GROUP BY src),
w AS MATERIALIZED (SELECT src, dst, deg FROM ps JOIN deg USING (src)),
r AS (SELECT id, {restart} AS rank, {restart} AS restart, deg IS NULL AS dangling, NULL::DOUBLE AS old, 0 AS step FROM pn LEFT JOIN deg ON src = id
  UNION ALL SELECT r.id, (0.15 + 0.85 * lost) * restart + 0.85 * coalesce(got, 0), restart, dangling, rank, step + 1
  FROM r LEFT JOIN (SELECT dst AS id, sum(rank / deg) AS got FROM w JOIN r ON r.id = src GROUP BY dst) g ON g.id = r.id
  CROSS JOIN (SELECT coalesce(sum(rank) FILTER (dangling), 0) AS lost, sum(abs(rank - old)) AS moved FROM r) t WHERE step = 0 OR moved >= 1e-7)
SELECT id, round(rank, 9) AS rank FROM r WHERE step = (SELECT max(step) FROM r)"""


@register("graph_simple_page_rank", _restarted("1.0::DOUBLE / (SELECT count(*) FROM pn)"))
def graph_simple_page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centrality.simple_page_rank(part_graph(spark, sf_dir)).select("id", F.round("rank", 9).alias("rank"))


@register("graph_personalised_rank", _restarted("CASE WHEN id = (SELECT min(id) FROM pn) THEN 1.0::DOUBLE ELSE 0.0 END"))
def graph_personalised_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = part_graph(spark, sf_dir)
    ranks = centrality.simple_page_rank(graph, sources=[graph.nodes.agg(F.min("id").alias("id")).first()["id"]])
    return ranks.select("id", F.round("rank", 9).alias("rank"))


@register(
    "graph_betweenness",
    # all simple paths of the small components, of which the shortest count
    f"""WITH RECURSIVE {RING_SQL}, both_ways AS MATERIALIZED (SELECT src, dst FROM rg UNION SELECT dst, src FROM rg),
    p AS (SELECT src AS s, dst AS t, [src, dst] AS way FROM both_ways
      UNION ALL SELECT s, dst, list_append(way, dst) FROM p JOIN both_ways ON src = t WHERE NOT list_contains(way, dst)),
    short AS MATERIALIZED (SELECT s, t, way, count(*) OVER (PARTITION BY s, t) AS n FROM (SELECT *, min(len(way)) OVER (PARTITION BY s, t) AS low FROM p) WHERE len(way) = low),
    inner_nodes AS (SELECT unnest(way[2:-2]) AS id, n FROM short)
    SELECT c_custkey AS id, round(coalesce(sum(1.0 / n), 0), 9)::DOUBLE AS score FROM customer LEFT JOIN inner_nodes ON id = c_custkey GROUP BY c_custkey""",
)
def graph_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centrality.betweenness(ring_graph(spark, sf_dir)).select("id", F.round("score", 9).alias("score"))


@register(
    "graph_katz",
    f"""WITH RECURSIVE {EDGE_SQL}, a AS MATERIALIZED (SELECT 1.0::DOUBLE / (max(n) + 1) AS alpha FROM (SELECT count(*) AS n FROM ps GROUP BY src)),
    r AS (SELECT id, 1.0::DOUBLE AS score, NULL::DOUBLE AS old, 0 AS step FROM pn
      UNION ALL SELECT r.id, alpha * coalesce(got, 0) + 0.1, score, step + 1
      FROM r LEFT JOIN (SELECT dst AS id, sum(score) AS got FROM ps JOIN r ON r.id = src GROUP BY dst) g ON g.id = r.id CROSS JOIN a
      CROSS JOIN (SELECT sqrt(sum((score - old) ** 2)) AS moved FROM r) t WHERE step = 0 OR moved >= 1e-8)
    SELECT id, round(score / sqrt(sum(score * score) OVER ()), 9) AS score FROM r WHERE step = (SELECT max(step) FROM r)""",
)
def graph_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centrality.katz(part_graph(spark, sf_dir)).select("id", F.round("score", 9).alias("score"))


@register(
    "graph_eigenvector",
    f"""WITH RECURSIVE {EDGE_SQL},
    r AS (SELECT id, 1.0::DOUBLE AS raw, 1.0::DOUBLE AS norm, 0.0::DOUBLE AS old, 0 AS step FROM pn
      UNION ALL SELECT id, got, sqrt(sum(got * got) OVER ()), CASE WHEN step = 0 THEN 0 ELSE norm END, step + 1
      FROM (SELECT r.id, norm, old, step, coalesce(g.got, 0) AS got
        FROM r LEFT JOIN (SELECT dst AS id, sum(raw / norm) AS got FROM ps JOIN r ON r.id = src GROUP BY dst) g ON g.id = r.id)
      WHERE step = 0 OR NOT (norm = 0 OR abs(norm - old) < 1e-9 OR step > 2 AND norm <= old))
    SELECT id, round(raw / CASE WHEN norm = 0 THEN 1 ELSE norm END, 8) AS score FROM r WHERE step = (SELECT max(step) FROM r)""",
)
def graph_eigenvector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centrality.eigenvector(part_graph(spark, sf_dir)).select("id", F.round("score", 8).alias("score"))


@register("graph_core_number", f"WITH {EDGE_SQL}{_cores(40).replace('SELECT src, dst FROM pe UNION ALL SELECT dst, src FROM pe', 'SELECT src, dst FROM ps')} SELECT id, coalesce(k, 0)::DOUBLE AS core_number FROM pn LEFT JOIN k40 USING (id)")
def graph_core_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.core_number(part_graph(spark, sf_dir))


@register("graph_strong_components", f"WITH RECURSIVE {RING_SQL}{_STRONG}")
def graph_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.strongly_connected(ring_graph(spark, sf_dir))


@register("graph_strong_components_kosaraju", f"WITH RECURSIVE {RING_SQL}{_STRONG}")
def graph_strong_components_kosaraju(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.strongly_connected_kosaraju(ring_graph(spark, sf_dir))


@register("graph_parallel_core_number", f"WITH {EDGE_SQL}{_cores(40).replace('SELECT src, dst FROM pe UNION ALL SELECT dst, src FROM pe', 'SELECT src, dst FROM ps')} SELECT id, coalesce(k, 0)::DOUBLE AS core_number FROM pn LEFT JOIN k40 USING (id)")
def graph_parallel_core_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core numbers once more: every round here is parallel, so this is the same operator."""
    return community.core_number(part_graph(spark, sf_dir))


@register("graph_louvain")
def graph_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.louvain(ring_graph(spark, sf_dir))


@register("graph_leiden")
def graph_leiden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.leiden(ring_graph(spark, sf_dir))


@register("graph_label_propagation")
def graph_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.label_propagation(part_graph(spark, sf_dir))


@register("graph_cut_clustering")
def graph_cut_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.cut_clustering(region_graph(spark, sf_dir), 0.3)


@register(
    "graph_steiner_core",
    # for each depth, what the first seed reaches through cores that deep
    f"""WITH RECURSIVE {EDGE_SQL}{_cores(40).replace('SELECT src, dst FROM pe UNION ALL SELECT dst, src FROM pe', 'SELECT src, dst FROM ps')},
    c AS MATERIALIZED (SELECT id, coalesce(k, 0) AS k FROM pn LEFT JOIN k40 USING (id)), seed AS (SELECT id FROM pn ORDER BY id LIMIT 2),
    reach AS (SELECT id, unnest(range(0, k + 1)) AS depth FROM c WHERE id = (SELECT min(id) FROM seed)
      UNION SELECT c.id, depth FROM reach JOIN ps ON src = reach.id JOIN c ON c.id = dst WHERE c.k >= depth)
    SELECT id, 0::BIGINT AS community_id, k AS coreness FROM reach JOIN c USING (id)
    WHERE depth = (SELECT max(depth) FROM reach WHERE id = (SELECT max(id) FROM seed))""",
)
def graph_steiner_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = part_graph(spark, sf_dir)
    seeds = [r["id"] for r in graph.nodes.orderBy("id").limit(2).collect()]
    return community.steiner_core(graph, seeds)


@register("graph_node2vec")
def graph_node2vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.node2vec(region_graph(spark, sf_dir))
