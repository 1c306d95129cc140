"""Mixing sources to target weights by hierarchical budgeting (native DataFrame functions alone).

Leaves are (domain, language, source). The token budget flows from the root to the leaves along the
weights. A node takes at most what its leaves can give in ``max_epochs`` passes; what it can't use goes
to its siblings first, and leaves the family only if all of them are full (water filling on the
capacities of the subtrees). A leaf gives whole passes and then the prefix of one seeded order
(MD5 of seed, epoch and doc_id) whose tokens fit the rest of its budget.

Tokens are runs of characters other than blank, tab, line feed and carriage return; an empty text, or one without any, counts as one
token, so that every row can be placed. A very long text is counted inside the JVM, and fits a rest only as a whole. Null text, domain,
language or source count as empty strings. Rows that share a doc_id, repeated rows among them, tie on the key and share their fate; a
null doc_id is ordered as the empty string. An empty table gives no rows. :func:`tempered` passes extra columns through, whatever
their names; the query leaves them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import forget, stored

LEVELS = ("domain", "lang", "source")
#: Leaf tables up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_LEAVES = 20_000
SEED = "mix-1"
#: Production parameters of the query: domains of the sources, and the weights of the tree's nodes.
DOMAIN_WEIGHTS = {"web": 50, "forum": 20, "reference": 30}
LANG_WEIGHTS = {"en": 60, "de": 15, "fr": 15, "es": 10}
BUDGET_PERCENT, MAX_EPOCHS = 80, 3


def domain_of(source: Column) -> Column:
    """The query's domain tree: src0-6 are web, src7-12 forum, all others reference."""
    n = F.try_to_number(F.substring(source, 4, 9), F.lit("999999999")).cast("int")
    return F.when(n <= 6, "web").when(n <= 12, "forum").otherwise("reference")


def count_tokens(text: Column) -> Column:
    runs = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \t\n\r]+", -1), lambda w: w != ""))
    return F.greatest(runs, F.lit(1)).cast("long")


def leaf_columns(docs: DataFrame, domain: Column) -> list[Column]:
    lang, source = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in LEVELS[1:])
    return [F.coalesce(domain, F.lit("")).alias("domain"), lang, source]


def fill(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Splits each parent's ``budget`` over its children by weight, none above its ``capacity``."""
    order = W.Window.partitionBy(*by).orderBy(F.col("capacity") / F.col("weight"), *LEVELS)
    before, rest = order.rowsBetween(W.Window.unboundedPreceding, -1), order.rowsBetween(0, W.Window.unboundedFollowing)
    free = (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.sum("weight").over(rest)
    level = nodes.withColumn("level", free).withColumn(
        "level", F.when(F.col("capacity") / F.col("weight") > F.col("level"), F.col("level"))
    )
    top = F.max("level").over(W.Window.partitionBy(*by))
    return level.withColumn(
        "given", F.least(F.col("capacity").cast("double"), F.coalesce(top * F.col("weight"), F.col("capacity")))
    )


def budgets(leaves: DataFrame, weight: list[Column], total: Column, max_epochs: int) -> DataFrame:
    """``leaves``: the levels and ``tokens``. ``weight``: one expression a level, over the levels and ``tokens``.

    Adds ``given`` (tokens, double), the leaf's share of ``total`` after shortages went to siblings, then to ancestors.
    """
    base = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    budget = leaves.agg(total.alias("budget"))
    done = None
    for depth in range(1, len(LEVELS) + 1):
        by, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        nodes = base.groupBy(*by).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        for c in LEVELS[depth:]:
            nodes = nodes.withColumn(c, F.lit(""))
        nodes = nodes.withColumn("weight", weight[depth - 1].cast("double"))
        if done is None:
            nodes = nodes.join(F.broadcast(budget))  # one row
        else:
            nodes = nodes.join(done.select(*parent, F.col("given").alias("budget")), parent)
        done = fill(nodes, parent)
    return done.select(*LEVELS, "tokens", "given")


def leaf_table(rows: DataFrame, save=stored) -> DataFrame:
    """The tokens of every leaf, kept: budgets read it once a level."""
    return save(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "leaf")


def order_key(seed: str, full: str = "full") -> Column:
    """The leaf's seeded order in its partial epoch."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(full).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def plan(rows: DataFrame, weight: list[Column], total: Column, max_epochs: int, seed: str, leaf: DataFrame | None = None) -> DataFrame:
    """``rows``: doc_id, levels, tokens. One row a leaf: whole passes ``full`` and the last key ``cut`` of the partial one.

    The cut is found by descending into ever finer ranges of the key, so no task sorts a whole leaf.
    """
    done: list[str] = []
    save = lambda df, name: stored(df, name, done)
    leaf = leaf_table(rows, save) if leaf is None else leaf
    small = few(leaf)
    given = budgets(leaf, weight, total, max_epochs)
    whole = F.floor(F.col("given") + 1e-6).cast("long")
    own = save(
        given.withColumn("budget", whole)
        .withColumn("full", F.floor(F.col("budget") / F.col("tokens")).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
        .select(*LEVELS, "tokens", "budget", "full", "rest"),
        "leaves",
    )
    by = list(LEVELS)
    keyed = with_leaf(rows.select("doc_id", *LEVELS, F.col("tokens").alias("n")), own.select(*LEVELS, "full", "rest"), small)
    keyed = keyed.withColumn("key", order_key(seed))
    for digits in (2, 5):
        part = F.substring("key", 1, digits)
        sums = keyed.groupBy(*by, part.alias("part"), "rest").agg(F.sum("n").alias("n"))
        upto = W.Window.partitionBy(*by).orderBy("part").rowsBetween(W.Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("n").over(upto))
        edge = (
            sums.where((F.col("upto") > F.col("rest")))
            .groupBy(*by)
            .agg(F.min_by(F.struct("part", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest")), "upto").alias("edge"))
        )
        edge = save(edge.select(*by, "edge.part", F.col("edge.rest").alias("rest")), "edge")
        keyed = with_leaf(keyed.drop("rest"), edge, small).where(part == F.col("part")).drop("part")
    upto = W.Window.partitionBy(*by, F.substring("key", 1, 5)).orderBy("key")
    inside = keyed.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") <= F.col("rest"))
    last = inside.groupBy(*by).agg(F.max("key").alias("last"))
    out = own.join(edge.withColumnRenamed("rest", "left"), by, "left").join(last, by, "left")
    # the keys below the edge part, and those in it up to the last that fits
    out = stored(out.withColumn("cut", F.coalesce("last", "part")).select(*LEVELS, "budget", "full", "cut"), "cuts")
    forget(rows.sparkSession, done)
    return out


def few(leaves: DataFrame) -> bool:
    """Whether a leaf table may be broadcast, by a count of its rows."""
    return leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES


def with_leaf(rows: DataFrame, leaves: DataFrame, small: bool) -> DataFrame:
    """Joins a leaf table, broadcast only if its counted rows are few."""
    return rows.join(F.broadcast(leaves) if small else leaves, list(LEVELS))


def copies(seed: str, full: str = "full", cut: str = "cut") -> Column:
    """How often a row is taken; a leaf without a ``cut`` was taken whole."""
    key = order_key(seed, full)
    return (F.col(full) + F.when(F.col(cut).isNotNull() & (key <= F.col(cut)), 1).otherwise(0)).cast("long")


def token_rows(docs: DataFrame, domain: Column) -> DataFrame:
    return stored(docs.select("doc_id", *leaf_columns(docs, domain), count_tokens(F.col("text")).alias("tokens")), "tokens")


def table_weight(column: str, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, w).otherwise(out)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its leaf, its tokens, the leaf's budget and how many epochs take it (0: none)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = token_rows(docs, domain_of(F.col("source")))
    weight = [table_weight("domain", DOMAIN_WEIGHTS, 10), table_weight("lang", LANG_WEIGHTS, 5), F.lit(1)]
    total = F.floor(F.sum("tokens") * BUDGET_PERCENT / 100)
    leaves = plan(rows, weight, total, MAX_EPOCHS, SEED)
    return with_leaf(rows, leaves, few(leaves)).select(
        "doc_id", *LEVELS, "tokens", F.col("budget").alias("leaf_budget"), copies(SEED).alias("epochs")
    )


def tempered(docs: DataFrame, seed: str, power: float = 0.9, max_epochs: int = 4) -> DataFrame:
    """The pipeline's mix: weights are a node's tokens to ``power``; the budget lets each leaf give one epoch at least.

    So no document is lost; leaves that the weights favour repeat a seeded prefix of theirs. All input columns return.
    """
    rows = token_rows(docs, domain_of(F.col("source")))
    weight = [F.pow("tokens", F.lit(power))] * 3
    # a leaf's share is at least (its tokens / all)^power; the budget that gives the largest leaf one epoch is enough
    leaf = leaf_table(rows)
    shares = budgets(leaf, weight, F.sum("tokens").cast("double"), 1 << 20)
    need = shares.agg(F.max(F.col("tokens") / F.col("given")).alias("need")).first()["need"] or 1.0
    total = F.ceil(F.sum("tokens") * F.lit(float(need)))
    leaves = plan(rows, weight, total, max_epochs, seed, leaf)
    own = docs.withColumn("__own", F.coalesce(domain_of(F.col("source")), F.lit("")))
    keys = leaves.select(*[F.col(c).alias(f"__{c}") for c in (*LEVELS, "full", "cut")])
    small = few(leaves)
    same = (F.col("__own") == F.col("__domain")) & (F.coalesce("lang", F.lit("")) == F.col("__lang")) & (
        F.coalesce("source", F.lit("")) == F.col("__source")
    )
    joined = own.join(F.broadcast(keys) if small else keys, same)
    return joined.withColumn("__n", F.explode(F.array_repeat(F.lit(0), copies(seed, "__full", "__cut").cast("int")))).select(*docs.columns)


def _table(column: str, weights: dict[str, int], other: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {other} END"


def _fill(source: str, by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""
SELECT *, least(capacity::DOUBLE, coalesce(max(CASE WHEN capacity / weight > level THEN level END) OVER ({part}) * weight, capacity)) AS given
FROM (SELECT *, (budget - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM ({source}) WINDOW o AS ({part} ORDER BY capacity / weight, domain, lang, source))"""


SQL = f"""
WITH t AS (
  SELECT doc_id, CASE WHEN n <= 6 THEN 'web' WHEN n <= 12 THEN 'forum' ELSE 'reference' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    greatest(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> '')), 1)::BIGINT AS tokens
  FROM (SELECT *, try_cast(source[4:] AS INTEGER) AS n FROM documents)),
l AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {MAX_EPOCHS} AS capacity FROM t GROUP BY ALL),
d1 AS ({_fill(f'''SELECT domain, '' AS lang, '' AS source, sum(capacity) AS capacity, ({_table('domain', DOMAIN_WEIGHTS, 10)})::DOUBLE AS weight,
  (SELECT floor(sum(tokens) * {BUDGET_PERCENT} / 100) FROM l) AS budget FROM l GROUP BY domain''', '')}),
d2 AS ({_fill(f'''SELECT x.*, d1.given AS budget FROM (SELECT domain, lang, '' AS source, sum(capacity) AS capacity,
  ({_table('lang', LANG_WEIGHTS, 5)})::DOUBLE AS weight FROM l GROUP BY domain, lang) x JOIN d1 USING (domain)''', 'domain')}),
d3 AS ({_fill('''SELECT l.*, 1::DOUBLE AS weight, d2.given AS budget FROM l JOIN d2 USING (domain, lang)''', 'domain, lang')}),
b AS (SELECT domain, lang, source, floor(given + 1e-6)::BIGINT AS leaf_budget, tokens AS have FROM d3),
k AS (SELECT t.*, leaf_budget, leaf_budget // have AS passes, leaf_budget % have AS rest,
  md5('{SEED}:' || (leaf_budget // have) || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM t JOIN b USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, leaf_budget,
  passes + (sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) <= rest)::BIGINT AS epochs FROM k
"""
