"""GQL statements, change capture and sources over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ai
from ..graph import GraphCatalogue, edges_from_csr
from ..sources.attach import attach_frames
from ..streaming.cdc import apply_changes, diff
from .catalogue import register, table
from .gql import GqlSession


def commerce(spark: SparkSession, sf_dir: str) -> GqlSession:
    c = GraphCatalogue()
    t = lambda n: table(spark, sf_dir, n)
    c.add_nodes("Nation", t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")))
    c.add_nodes("Customer", t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))
    c.add_nodes("Orders", t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")))
    c.add_edges("LIVES_IN", "Customer", "Nation", t("customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("dst"), F.col("c_custkey").alias("rel")))
    c.add_edges("PLACED", "Customer", "Orders", t("orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_orderkey").alias("rel")))
    return GqlSession(spark, c)


def _gql(name: str, text: str, sql: str) -> None:
    register(name, sql)(lambda spark, sf_dir: commerce(spark, sf_dir).run(text))


_gql(
    "gql_group",
    "SELECT n.name AS nation, count(*) AS orders, max(o.price) AS top FROM main MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Orders) GROUP BY n.name HAVING count(*) > 10",
    "SELECT n_name AS nation, count(*) AS orders, max(o_totalprice) AS top FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name HAVING count(*) > 10",
)
_gql(
    "gql_optional",
    "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders WHERE o.status = 'F') RETURN c.id AS customer, count(o.id) AS n",
    "SELECT c_custkey AS customer, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
)
_gql(
    "gql_filter_page",
    "MATCH (c:Customer)-[:PLACED]->(o:Orders) FILTER o.price > 1000 AND PROPERTY_EXISTS(c, balance) RETURN c.name AS name, o.id AS o, o.price AS price ORDER BY price DESC, o OFFSET 3 LIMIT 15",
    "SELECT c_name AS name, o_orderkey AS o, o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 1000 AND c_acctbal IS NOT NULL ORDER BY price DESC, o LIMIT 15 OFFSET 3",
)
_gql(
    "gql_labels",
    "MATCH (x:Nation|Customer) RETURN LABEL(x) AS label, count(*) AS n",
    "SELECT 'Nation' AS label, count(*) AS n FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer",
)
_gql("gql_for", "FOR x IN [1, 2, 3] RETURN x * 10 AS y", "SELECT unnest([10, 20, 30])::INTEGER AS y")
_gql(
    "gql_shared_nation",
    "MATCH (a:Customer)-[:LIVES_IN]->(n:Nation)<-[:LIVES_IN]-(b:Customer) WHERE a.balance > 9000 AND b.balance > 9000 AND a.id < b.id RETURN n.name AS nation, count(*) AS pairs",
    """SELECT n_name AS nation, count(*) AS pairs FROM nation JOIN customer a ON a.c_nationkey = n_nationkey JOIN customer b ON b.c_nationkey = n_nationkey
       WHERE a.c_acctbal > 9000 AND b.c_acctbal > 9000 AND a.c_custkey < b.c_custkey GROUP BY n_name""",
)


def mixed(spark: SparkSession, sf_dir: str) -> GqlSession:
    """Customers with a JSON value of one of four types, as text and as a variant."""
    c = GraphCatalogue()
    number, name = F.floor("c_acctbal").cast("string"), F.concat(F.lit('"'), "c_name", F.lit('"'))
    kind = F.col("c_custkey") % 4
    text = F.when(kind == 0, number).when(kind == 1, name).when(kind == 2, (F.col("c_custkey") % 8 == 2).cast("string")).otherwise(F.concat(F.lit("["), "c_custkey", F.lit("]")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 6).alias("bin"), F.col("c_name").alias("name"), text.alias("text"))
    c.add_nodes("Item", rows.withColumn("value", F.parse_json("text")))
    return GqlSession(spark, c)


MIXED_SQL = """WITH i AS (SELECT c_custkey AS id, c_custkey % 6 AS bin, c_name AS name,
  CASE c_custkey % 4 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 1 THEN 3 ELSE 4 END AS kind,
  CASE c_custkey % 4 WHEN 0 THEN floor(c_acctbal)::BIGINT WHEN 3 THEN c_custkey WHEN 2 THEN (c_custkey % 8 = 2)::BIGINT ELSE 0 END AS num,
  CASE c_custkey % 4 WHEN 0 THEN floor(c_acctbal)::BIGINT::VARCHAR WHEN 1 THEN '"' || c_name || '"' WHEN 2 THEN (c_custkey % 8 = 2)::VARCHAR ELSE '[' || c_custkey || ']' END AS text
  FROM customer) """
register(
    "gql_mixed_aggregates",
    MIXED_SQL + "SELECT bin, first(text ORDER BY kind, num, name) AS low, first(text ORDER BY kind DESC, num DESC, name DESC) AS high, count(*) AS n FROM i GROUP BY bin",
)(lambda spark, sf_dir: mixed(spark, sf_dir).run("MATCH (i:Item) RETURN i.bin AS bin, to_json(MIN(i.value)) AS low, to_json(MAX(i.value)) AS high, count(*) AS n"))
register(
    "gql_mixed_order",
    MIXED_SQL + "SELECT id, text FROM i WHERE kind = 2 AND num >= 100 OR kind = 3 OR kind = 4 AND num < 1000 ORDER BY kind DESC, num DESC, name DESC, id LIMIT 60",
)(lambda spark, sf_dir: mixed(spark, sf_dir).run(
    "MATCH (i:Item) WHERE _GQL_GE(i.text, '[100]') AND _GQL_LT(i.text, '1000') RETURN i.id AS id, i.text AS text ORDER BY i.value DESC, i.name DESC, id LIMIT 60"
))


@register(
    "cdc_apply",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
    SELECT user_id, event_type, value FROM r WHERE n = 1 AND event_type <> (SELECT min(event_type) FROM events)""",
)
def cdc_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a change feed of users: the last event is the user's row, the first event type in order deletes it."""
    events = table(spark, sf_dir, "events")
    gone = events.agg(F.min("event_type").alias("t")).first()["t"]
    changes = events.select("user_id", "event_type", "value", F.col("event_id").alias("seq"), F.when(F.col("event_type") == gone, "delete").otherwise("upsert").alias("op"))
    return apply_changes(changes.select("user_id", "event_type", "value").limit(0), changes, ["user_id"])


@register(
    "cdc_merge",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events), l AS (SELECT * FROM r WHERE n = 1)
    SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM l)
    UNION ALL SELECT user_id, value FROM l WHERE event_type <> (SELECT min(event_type) FROM events)""",
)
def cdc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events change the customers that are there: balances are replaced, rows deleted, unknown keys inserted."""
    events = table(spark, sf_dir, "events")
    gone = events.agg(F.min("event_type").alias("t")).first()["t"]
    op = F.when(F.col("event_type") == gone, "delete").otherwise("upsert")
    changes = events.select(F.col("user_id").alias("c_custkey"), F.col("value").alias("c_acctbal"), F.col("event_id").alias("seq"), op.alias("op"))
    return apply_changes(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), changes, ["c_custkey"])


@register(
    "cdc_diff",
    "SELECT c_custkey, 'upsert' AS op FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'delete' FROM customer WHERE c_acctbal > 9500",
)
def cdc_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of the customers: debts are cleared, the richest leave."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    new = old.where("c_acctbal <= 9500").withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(0.0)))
    up, down = diff(old, new, ["c_custkey"])
    return up.select("c_custkey", F.lit("upsert").alias("op")).unionByName(down.select("c_custkey", F.lit("delete").alias("op")))


@register("attached_sql", "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey")
def attached_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = attach_frames(spark, {"supplier": table(spark, sf_dir, "supplier")})
    return db.sql_query("SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey")


@register("csr_edges", "SELECT c_nationkey::BIGINT AS src, c_custkey AS dst FROM customer")
def csr_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation in compressed rows, expanded to edges again."""
    from pyspark.sql import window as W

    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("node"), F.col("c_custkey").alias("dst"))
    counts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node")).join(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node", "left")
    counts = counts.unionByName(counts.agg((F.max("node") + 1).alias("node"), F.lit(0).cast("long").alias("n")))
    order = W.Window.orderBy("node").rowsBetween(W.Window.unboundedPreceding, -1)  # one row a nation
    indptr = counts.select("node", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(order), F.lit(0)).alias("start"))
    inner = W.Window.partitionBy("node").orderBy("dst")
    indices = rows.withColumn("nth", F.row_number().over(inner) - 1).join(indptr, "node").select((F.col("start") + F.col("nth")).alias("position"), "dst")
    return edges_from_csr(indptr, indices).select("src", "dst")


@register("ai_embedding")
def ai_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", ai.create_embedding(F.col("text"), "offline", "words", 32).alias("embedding"))
