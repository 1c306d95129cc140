"""Sharding by balanced label propagation, under the law of equal row counts.

Documents are linked by lines of ``LINE_CHARS`` characters or more that they share; equal texts are one node
from the start, with its rows as weight. Nodes and lines form a bipartite graph, so no pair of documents is
ever made. Each round a line tells its nodes which shards hold its documents, a node wants the shard with the most
of its links, and the shards take movers in order of their gain as far as their quota of rows goes. At the end the rows beyond
a shard's quota, loosest first, fill the gaps of the others: counts are at most one apart, exactly, and only a
group of equal texts larger than what is free is split.

A null text counts as empty; rows without long shared lines follow a hash. A very long text is split to lines inside the JVM and is one row
like others. Rows that repeat are placed each on their own. A null doc_id is placed like any other. Ties between shards go to the lowest
number. An empty table gives no rows; extra columns, whatever their names, are left out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import forget, stored

SHARDS, ROUNDS, LINE_CHARS = 40, 3, 40
#: A line with more than one in so many of all links is dealt in parts.
HOT_LINES = 4096
#: Rows that a task numbers at a time, about; movers' gains are told apart in so many steps.
PIECE_ROWS, GAINS = 50_000, 16


def measured(docs: DataFrame) -> DataFrame:
    """What placing needs of a row: id, size, checksum, and the node that equal texts share."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("node"),
    )


def links(docs: DataFrame, save, min_chars: int = LINE_CHARS) -> DataFrame:
    """``node, line, nodes, salts, salt``: the distinct long lines of each distinct text that another text has too.

    ``nodes`` counts the texts of a line. Lines that hold more than their share of all links (there are fewer than ``HOT_LINES``
    such) are dealt in ``salts`` parts, ``salt`` is the link's.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(x) >= min_chars)
    each = docs.select(F.xxhash64(text).alias("node"), F.explode(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))).alias("line"))
    each = save(each.distinct(), "lines")
    common = save(each.groupBy("line").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1"), "common")
    share = max(1, (common.agg(F.sum("nodes").alias("n")).first()["n"] or 0) // HOT_LINES)
    salts = F.ceil(F.col("nodes") / share).cast("int")
    hot = F.broadcast(common.where(F.col("nodes") > share).select("line", salts.alias("salts")))  # fewer than HOT_LINES rows
    own = each.join(hot, "line", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"), F.lit(0)))
    known = common.withColumn("salts", salts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return save(own.drop("salts").join(known.hint("merge"), ["line", "salt"]).select("node", "line", "nodes", "salts", "salt"), "links")


def as_map(values: list) -> Column:
    """One number a shard."""
    return F.array(*[F.lit(v) for v in values])


def propagate(state: DataFrame, edges: DataFrame, shards: int, quota: int, save) -> DataFrame:
    """One round: ``node, rows, shard`` moves towards the shards of its lines, as far as quotas go.

    Rows outside the graph can always give way at the end, so a shard's room is its whole quota.
    """
    held = save(edges.join(state.hint("merge"), "node"), "held")
    by_shard = held.groupBy("line", "salts", "shard").agg(F.sum("rows").alias("rows"))
    wanted = by_shard.groupBy("line", "salts").agg(
        F.max_by("shard", F.struct("rows", -F.col("shard"))).alias("to"), F.sum("rows").alias("all"), F.max("rows").alias("most")
    )
    # a line's vote weighs less the more documents share it
    wanted = wanted.select("line", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "to", (F.col("most") / (F.col("all") * F.col("all"))).alias("pull"))
    votes = held.join(wanted.hint("merge"), ["line", "salt"]).groupBy("node", "rows", "shard", "to").agg(F.sum("pull").alias("pull"))
    best = votes.groupBy("node", "rows", "shard").agg(
        F.max_by(F.struct("to", "pull"), F.struct("pull", -F.col("to"))).alias("best"), F.max(F.when(F.col("to") == F.col("shard"), F.col("pull"))).alias("stay")
    )
    gain = F.col("best.pull") - F.coalesce("stay", F.lit(0.0))
    step = F.least(F.lit(GAINS - 1), F.greatest(F.lit(0), (F.log2(gain) + GAINS).cast("int")))
    moves = best.select("node", "rows", "shard", F.col("best.to").alias("to"), F.when((F.col("best.to") != F.col("shard")) & (gain > 1e-12), step).alias("step"))
    moves = save(moves, "moves")
    # who moves is settled by a table of shards and steps: those above the step that overflows, of that step a share by hash
    now, asked = [0] * shards, {}
    for r in moves.groupBy("shard", "to", "step").agg(F.sum("rows").alias("rows")).collect():  # shards x shards x steps rows at most
        now[r["shard"]] += r["rows"]
        if r["step"] is not None:
            asked[r["to"], r["step"]] = asked.get((r["to"], r["step"]), 0) + r["rows"]
    share = [0.0] * (shards * GAINS)
    for s in range(shards):
        room = max(0, quota - now[s])
        for step in range(GAINS - 1, -1, -1):
            n = asked.get((s, step), 0)
            take = min(n, room)
            share[s * GAINS + step] = take / n if n else 0.0
            room -= take
    part = F.coalesce(F.element_at(as_map(share), F.col("to") * GAINS + F.col("step") + 1), F.lit(0.0))
    lucky = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 20)) < part * (1 << 20)
    return moves.select("node", "rows", F.when(lucky, F.col("to")).otherwise(F.col("shard")).alias("shard"))


def numbered(rows: DataFrame, by: str, order: list[Column], pieces: int, piece: Column, name: str) -> DataFrame:
    """Gapless numbers from 0 within ``by``, in the order of ``piece`` and then ``order``; a task numbers one piece of a group."""
    cut = rows.withColumn("__piece", piece)
    counts = cut.groupBy(by, "__piece").agg(F.count(F.lit(1)).alias("__n"))
    before = W.Window.partitionBy(by).orderBy("__piece").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counts.select(by, "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inner = F.row_number().over(W.Window.partitionBy(by, "__piece").orderBy(*order))
    return cut.withColumn("__at", inner).join(starts.hint("merge"), [by, "__piece"]).withColumn(name, F.col("__start") + F.col("__at") - 1).drop("__piece", "__at", "__start")


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    done: list[str] = []
    save = lambda df, name: stored(df, name, done)
    rows = save(measured(docs), "rows")
    nodes = save(rows.groupBy("node").agg(F.count(F.lit(1)).alias("rows")), "nodes")
    total = nodes.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    edges = links(docs, save)
    quota = -(-total // shards)
    # documents of one line start together: a node starts in the shard of its rarest line
    rare = edges.groupBy("node").agg(F.min_by("line", F.struct("nodes", "line")).alias("line"))
    state = save(
        nodes.join(rare.hint("merge"), "node", "left").select("node", "rows", F.pmod(F.xxhash64(F.coalesce("line", "node")), F.lit(shards)).cast("int").alias("shard"), F.col("line").isNotNull().alias("linked")),
        "state",
    )
    graph = state.where("linked").select("node", "rows", "shard")
    for _ in range(rounds):
        graph = propagate(graph, edges, shards, quota, save)
    placed = state.where("NOT linked").select("node", "rows", "shard", F.lit(0).alias("tie")).unionByName(graph.withColumn("tie", F.lit(1)))
    # rows beyond the quota move: single rows first, those without links before the others; a group's rows stand together
    pieces = max(1, -(-total // (shards * PIECE_ROWS)))
    own = rows.join(placed.select("node", "shard", (F.col("tie") + 2 * (F.col("rows") > 1).cast("int")).alias("tie"), F.col("rows").alias("of")).hint("merge"), "node")
    rank = [F.col("of").desc(), F.col("node"), F.col("doc_id").asc_nulls_first()]
    # a large group of copies is a piece of its own kind: its rows are dealt over pieces too, by doc_id
    big = F.col("of") > PIECE_ROWS
    spread = F.pmod(F.when(big, F.xxhash64("node", "doc_id")).otherwise(F.xxhash64("node", F.lit(3))), F.lit(pieces))
    piece = F.when(big, F.lit(-pieces)).otherwise((3 - F.col("tie")) * pieces) + spread
    ranked = save(numbered(own, "shard", rank, pieces, piece, "rank"), "ranked")
    held = {r["shard"]: r["rows"] for r in ranked.groupBy("shard").agg(F.count(F.lit(1)).alias("rows")).collect()}
    now = [held.get(s, 0) for s in range(shards)]
    target = [total // shards + (s < total % shards) for s in range(shards)]
    # the surplus rows of all shards, counted through, fill the gaps of the others in turn
    surplus, given, gaps, filled = [], 0, [], 0
    for s in range(shards):
        surplus.append(given - target[s])
        given += max(0, now[s] - target[s])
        free = max(0, target[s] - now[s])
        if free:
            gaps.append((filled, s))
        filled += free
    gaps = gaps or [(0, 0)]
    over = F.col("rank") >= F.element_at(as_map(target), F.col("shard") + 1)
    place = F.element_at(as_map(surplus), F.col("shard") + 1) + F.col("rank")
    at = F.greatest(F.size(F.filter(as_map([g[0] for g in gaps]), lambda x: x <= F.col("place"))), F.lit(1))
    final = ranked.withColumns({"over": over, "place": place}).withColumn("gap", at)
    to = F.element_at(as_map([g[1] for g in gaps]), F.col("gap"))
    # a row that stays keeps its rank as slot, those that come fill the slots above the shard's own rows
    above = F.element_at(as_map([now[s] - start for start, s in gaps]), F.col("gap")) + F.col("place")
    out = stored(
        final.select(
            "doc_id", "size", "text_crc32", F.when(F.col("over"), to).otherwise(F.col("shard")).cast("int").alias("shard"),
            F.when(F.col("over"), above).otherwise(F.col("rank")).cast("long").alias("slot"),
        ),
        "shards",
    )
    forget(spark, done)
    return out


def result(docs: DataFrame) -> DataFrame:
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
