"""Distances and paths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..graph import GraphError, ProjectedGraph
from ..storage import Loop, stored
from .pieces import Local, out_of, pieces, roots, starts

#: Paths up to this many edges are one plan of joins; longer ones are built from stored levels.
UNROLLED = 3


def bfs_distance(graph: ProjectedGraph, source: int) -> DataFrame:
    """Directed hops from ``source``; -1.0 where it doesn't lead: ``id, distance``."""
    nodes = graph.nodes.select("id")
    if source is None or not nodes.where(F.col("id") == source).limit(1).count():
        raise GraphError("source is not a node of the graph.")
    cut = pieces(graph)
    at = cut.placed.where(F.col("id") == source).select("piece").first()
    if at is None:  # tied to no other node
        return nodes.select("id", F.when(F.col("id") == source, 0.0).otherwise(-1.0).alias("distance"))
    if at["piece"] is None:
        return _bfs_rounds(nodes, cut.rest(graph), source)

    def search(of: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        own = Local(of["src"], of["dst"])
        s, d = own.directed()
        begin, depth = starts(own.n, s), np.full(own.n, -1.0)
        front, n = np.searchsorted(own.ids, [source]), 0
        while len(front):
            depth[front] = n
            to = np.unique(d[out_of(begin, front)[0]])
            front, n = to[depth[to] < 0], n + 1
        return {"id": own.ids, "distance": depth}

    found = stored(cut.only(at["piece"]).each(search, "id long, distance double"), "distances")
    return nodes.join(found, "id", "left").select("id", F.coalesce("distance", F.lit(-1.0)).alias("distance"))


def _bfs_rounds(nodes: DataFrame, graph: ProjectedGraph, source: int) -> DataFrame:
    edges = stored(graph.directed(), "edges").repartition("src").persist()
    loop = Loop()
    seen = loop.keep(nodes.where(F.col("id") == source).select("id", F.lit(0.0).alias("distance")))
    depth = 0
    while True:
        front = seen.where(F.col("distance") == depth).select(F.col("id").alias("src"))
        new = edges.join(front, "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        depth += 1
        seen = loop.keep(seen.unionByName(new.withColumn("distance", F.lit(float(depth)))))
        if not seen.where(F.col("distance") == depth).limit(1).count():
            break
    edges.unpersist()
    return nodes.join(seen, "id", "left").select("id", F.coalesce("distance", F.lit(-1.0)).alias("distance"))


def distances_from_all(graph: ProjectedGraph) -> DataFrame:
    """For each node how many others lie at each distance of the simple graph: ``id, distance, nodes``.

    Components whose pairs of nodes fit a task are searched there; the others by rounds over the cluster.
    """
    cut = pieces(graph, weight="nodes * nodes + edges")
    found = stored(cut.each(_distances_piece, "id long, distance int, nodes long"), "distances")
    return found.unionByName(_distances_rounds(cut.rest(graph).simple())) if cut.beyond else found


def _distances_piece(of: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    own = Local(of["src"], of["dst"])
    s, d = own.simple()
    begin, comp = starts(own.n, s), roots(own.n, s, d)
    size, order = np.bincount(comp, minlength=own.n), np.argsort(comp, kind="stable")
    nth = np.empty(own.n, dtype=np.int64)  # of a node in its component
    nth[order] = np.arange(own.n) - np.concatenate(([0], np.cumsum(size)))[:-1][comp[order]]
    row = np.concatenate(([0], np.cumsum(size[comp])))  # a row of pairs for each source
    seen = np.zeros(row[-1], dtype=bool)
    source = to = np.arange(own.n)
    seen[row[source] + nth[to]] = True
    depth, out = 0, []
    while len(source):
        at, which = out_of(begin, to)
        source, to = source[which], d[at]
        key, first = np.unique(row[source] + nth[to], return_index=True)
        first = first[~seen[key]]
        seen[key] = True
        source, to, depth = source[first], to[first], depth + 1
        count = np.bincount(source, minlength=own.n)
        some = np.flatnonzero(count)
        out.append((own.ids[some], np.full(len(some), depth, dtype=np.int32), count[some]))
    return {c: np.concatenate([x[i] for x in out]) for i, c in enumerate(("id", "distance", "nodes"))}


def _distances_rounds(edges: DataFrame) -> DataFrame:
    """All sources search at once: a round joins the pairs found last with the edges. Pairs grow with the square of a component, as the measure itself does."""
    edges = stored(edges, "edges").repartition("src").persist()
    loop = Loop()
    seen = loop.keep(edges.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.lit(1).alias("distance")))
    depth = 1
    while True:
        front = seen.where(F.col("distance") == depth).select("id", F.col("to").alias("src"))
        new = front.join(edges, "src").where("id <> dst").select("id", F.col("dst").alias("to")).distinct()
        new = new.join(seen.select("id", "to"), ["id", "to"], "left_anti")
        depth += 1
        seen = loop.keep(seen.unionByName(new.withColumn("distance", F.lit(depth))))
        if not seen.where(F.col("distance") == depth).limit(1).count():
            break
    edges.unpersist()
    return seen.groupBy("id", "distance").agg(F.count(F.lit(1)).alias("nodes"))


def weighted_distance(graph: ProjectedGraph, source: int, weight: str) -> DataFrame:
    """Least cost from ``source`` along directed edges (Bellman-Ford): ``id, cost``; unreachable nodes are left out."""
    if weight not in graph.edges.columns:
        raise GraphError(f"Cannot find property {weight}")
    cheap = graph.edges.groupBy("src", "dst").agg(F.min(F.col(weight).cast("double")).alias("w"))
    if cheap.where("w < 0").limit(1).count():
        raise GraphError("weights must not be negative.")
    edges = stored(cheap, "edges").repartition("src").persist()
    loop = Loop()
    state = loop.keep(graph.nodes.where(F.col("id") == source).select("id", F.lit(0.0).alias("cost"), F.lit(True).alias("moved")))
    while True:
        reach = edges.join(state.where("moved").select(F.col("id").alias("src"), "cost"), "src")
        best = reach.groupBy(F.col("dst").alias("id")).agg(F.min(F.col("cost") + F.col("w")).alias("via"))
        better = F.col("via").isNotNull() & (F.col("cost").isNull() | (F.col("via") < F.col("cost")))
        state = loop.keep(
            state.select("id", "cost").join(best, "id", "full").select("id", F.when(better, F.col("via")).otherwise(F.col("cost")).alias("cost"), better.alias("moved"))
        )
        if not state.where("moved").limit(1).count():
            break
    edges.unpersist()
    return state.select("id", "cost")


def walks(edges: DataFrame, least: int, most: int | None, mode: str = "WALK", start: DataFrame | None = None) -> DataFrame:
    """Directed paths of ``least`` to ``most`` edges: ``src, dst, nodes array, rels array``.

    ``edges`` has ``src, dst, rel``. Modes: WALK (anything), TRAIL (no edge twice), ACYCLIC (no node twice), SIMPLE (no node
    twice, but the last may be the first). ``start`` (``id``) limits the first node. Paths are pruned as they grow; each level is
    stored. ``most`` None goes on until no path grows, which a WALK need not reach.
    """
    if least < 0 or most is not None and most < least:
        raise GraphError("a path's bounds must be 0 <= least <= most.")
    if most is None and mode == "WALK":
        raise GraphError("walks without an upper bound may be endless: bound them, or take TRAIL, ACYCLIC or SIMPLE.")
    ids = start if start is not None else edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    paths = ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.array("id").alias("nodes"), F.expr("cast(array() as array<bigint>)").alias("rels"))
    out = paths if least == 0 else None
    steps = edges.select(F.col("src").alias("dst"), F.col("dst").alias("__to"), F.col("rel").cast("long").alias("__rel"))
    n = 0
    while most is None or n < most:
        n += 1
        grown = paths.join(steps, "dst")
        if mode == "TRAIL":
            grown = grown.where(~F.array_contains("rels", F.col("__rel")))
        elif mode == "ACYCLIC":
            grown = grown.where(~F.array_contains("nodes", F.col("__to")))
        elif mode == "SIMPLE":
            closed = (F.size("rels") > 0) & (F.col("src") == F.col("dst"))  # a closed path ends there
            grown = grown.where(~closed & (~F.array_contains("nodes", F.col("__to")) | (F.col("__to") == F.col("src"))))
        elif mode != "WALK":
            raise GraphError(f"unknown path mode {mode}")
        paths = grown.select("src", F.col("__to").alias("dst"), F.concat("nodes", F.array("__to")).alias("nodes"), F.concat("rels", F.array("__rel")).alias("rels"))
        if most is None or most > UNROLLED:
            paths = stored(paths, "level")
            if paths.isEmpty():
                break
        if n >= least:
            out = paths if out is None else out.unionByName(paths)
    return paths.limit(0) if out is None else out


def shortest_paths(edges: DataFrame, sources: DataFrame, which: str = "ALL", most: int | None = None, least: int = 1) -> DataFrame:
    """All shortest directed paths from ``sources`` (``id``), or with ``ANY`` one a pair: ``src, dst, length, nodes, rels``.

    Without ``most`` it goes on until no new pair is found. A level keeps only nodes that no earlier level reached from that source; paths that tie stay for ALL, ANY takes the least by its edges.
    """
    steps = edges.select(F.col("src").alias("dst"), F.col("dst").alias("__to"), F.col("rel").cast("long").alias("__rel"))
    front = sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.array("id").alias("nodes"), F.expr("cast(array() as array<bigint>)").alias("rels"))
    seen = front.select("src", "dst")
    out = front.withColumn("length", F.lit(0)) if least == 0 else None
    loop = Loop(every=1)
    n = 0
    while most is None or n < most:
        n += 1
        grown = front.join(steps, "dst").select("src", F.col("__to").alias("dst"), F.concat("nodes", F.array("__to")).alias("nodes"), F.concat("rels", F.array("__rel")).alias("rels"))
        grown = grown.join(seen, ["src", "dst"], "left_anti")
        if which == "ANY":
            grown = grown.withColumn("__n", F.row_number().over(W.Window.partitionBy("src", "dst").orderBy("rels"))).where("__n = 1").drop("__n")
        front = loop.keep(grown)
        if not front.limit(1).count():
            break
        out = front.withColumn("length", F.lit(n)) if out is None else out.unionByName(front.withColumn("length", F.lit(n)))
        seen = seen.union(front.select("src", "dst").distinct())
    if out is None:
        out = front.withColumn("length", F.lit(0))
    return out
