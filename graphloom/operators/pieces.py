"""Whole components as pieces: what never leaves a component is worked out there by one task, without a round over the cluster.

Components are found first. Those of many edges are a piece each, small ones share pieces by hash, so a task holds ``PIECE_EDGES``
edges at most whatever the graph's size. A component beyond that is left to the operators' rounds over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import ProjectedGraph
from ..storage import forget, stored
from .components import components

#: Edges of a component that one task takes at most (two arrays of 32 MB, and some ten times that while they are sorted).
PIECE_EDGES = 4_000_000
#: Edges that small components share a piece with, about.
SHARED_EDGES = 200_000
#: Edges that a task folds at once.
FOLD_EDGES = 1_000_000


def roots(n: int, s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The least node that each of ``n`` nodes is tied to by the edges ``s, d``."""
    p = np.arange(n)
    while len(s):
        a, b = p[s], p[d]
        live = a != b
        s, d, a, b = s[live], d[live], a[live], b[live]
        np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
        while len(s):
            up = p[p]
            if np.array_equal(up, p):
                break
            p = up
    return p


def _least(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the edges, and the least that each is tied to."""
    ids, at = np.unique(both, return_inverse=True)
    at = at.reshape(both.shape)
    return ids, ids[roots(len(ids), at[0], at[1])]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.stack((b.column(0).to_numpy(), b.column(1).to_numpy())) for b in batches]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _least(np.concatenate(held, axis=1))], names=["id", "component"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as ties of each node to the least one it reaches within the task."""
    held: list[np.ndarray] = []
    size = 0

    def tied() -> np.ndarray:
        ids, least = _least(np.concatenate(held, axis=1))
        off = ids != least
        return np.stack((ids[off], least[off]))

    def out(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], names=["src", "dst"])

    for batch in batches:
        held.append(np.stack((batch.column(0).to_numpy(), batch.column(1).to_numpy())))
        size += held[-1].shape[1]
        if size >= FOLD_EDGES:
            held = [tied()]
            size = held[0].shape[1]
            if size >= FOLD_EDGES // 2:
                yield from out(held[0])
                held, size = [], 0
    if size:
        yield from out(tied())


@dataclass(frozen=True)
class Pieces:
    """``placed`` has ``id, component, piece`` of every node with an edge to another; ``edges`` the pieces' ``piece, src, dst, ...``."""

    placed: DataFrame
    edges: DataFrame
    #: Whether a component is too large for a piece; its nodes have no piece.
    beyond: bool
    paths: list[str]

    def each(self, solve: Callable[..., Iterable[dict[str, np.ndarray]] | dict[str, np.ndarray]], kind: str) -> DataFrame:
        """``solve`` over the columns (by name) of every piece's edges; what it returns are columns of ``kind``."""
        names = [c for c in self.edges.columns if c != "piece"]
        shape = [x.split()[0] for x in kind.split(",")]

        def one(table: pa.Table) -> pa.Table:
            found = solve({c: table.column(c).to_numpy() for c in names})
            return pa.table({c: pa.array(found[c]) for c in shape})

        return self.edges.groupBy("piece").applyInArrow(one, kind)

    def only(self, piece: int) -> Pieces:
        return replace(self, edges=self.edges.where(F.col("piece") == piece))

    def measured(self, run: Callable, rounds: int) -> dict[int, float]:
        """``run(local, columns, rounds)`` gives scores and a measure a round; the measures of all pieces added, by round from 1."""

        def solve(of: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            return {"round": np.arange(1, rounds + 1), "m": np.asarray(run(Local(of["src"], of["dst"]), of, rounds)[1], dtype=np.float64)}

        return {r["round"]: r["m"] for r in self.each(solve, "round long, m double").groupBy("round").agg(F.sum("m").alias("m")).collect()}

    def scored(self, run: Callable, rounds: int, kind: str = "double") -> DataFrame:
        """``id, score`` after so many rounds."""

        def solve(of: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            own = Local(of["src"], of["dst"])
            return {"id": own.ids, "score": run(own, of, rounds)[0]}

        return self.each(solve, f"id long, score {kind}")

    def rest(self, graph: ProjectedGraph) -> ProjectedGraph:
        """The graph of the components too large for a piece."""
        ids = self.placed.where("piece IS NULL").select("id")
        return ProjectedGraph(ids, graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi"))

    def forget(self) -> None:
        forget(self.edges.sparkSession, self.paths)


def labelled(edges: DataFrame, kept: list[str]) -> DataFrame:
    """``id, component`` as of ``components``; edges fold within ranges of sources first, and what is left takes one task or rounds."""
    found = edges.where("src <> dst").select("src", "dst").repartitionByRange("src").mapInArrow(_fold, "src long, dst long")
    folded = stored(found, "ties", kept)
    if folded.count() <= PIECE_EDGES:  # what one task takes
        return stored(folded.coalesce(1).mapInArrow(_whole, "id long, component long"), "labels", kept)
    return stored(components(folded), "labels", kept)


def pieces(graph: ProjectedGraph, columns: dict | None = None, weight: str = "edges") -> Pieces:
    """The graph's components as pieces. ``columns`` are further columns made from ``src, dst``.

    A component's ``weight`` is an SQL expression of its ``edges`` and ``nodes``, and is held against ``PIECE_EDGES``.
    """
    paths: list[str] = []
    edges = stored(graph.edges.select("src", "dst"), "edges", paths)
    labels = labelled(edges, paths)
    degree = edges.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    sizes = labels.join(degree, "id", "left").groupBy("component").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.count(F.lit(1)).alias("nodes"))
    sizes = stored(sizes.select("component", F.expr(weight).cast("double").alias("weight")), "sizes", paths)
    small = F.col("weight") < SHARED_EDGES / 4
    told = sizes.agg(F.max("weight").alias("most"), F.coalesce(F.sum(F.when(small, F.col("weight"))), F.lit(0.0)).alias("small")).first()
    shared = -1 - F.pmod(F.xxhash64("component"), F.lit(int(told["small"] // SHARED_EDGES) + 1))
    piece = F.when(small, shared).when(F.col("weight") <= PIECE_EDGES, F.abs("component") * 2 + (F.col("component") < 0).cast("int"))
    placed = stored(labels.join(sizes.select("component", piece.alias("piece")), "component").select("id", "component", "piece"), "placed", paths)
    dealt = edges.join(placed.where("piece IS NOT NULL").select(F.col("id").alias("src"), "piece"), "src")
    dealt = dealt.select("piece", "src", "dst", *[c.alias(n) for n, c in (columns or {}).items()])
    return Pieces(placed, dealt, (told["most"] or 0) > PIECE_EDGES, paths)


def settle(cut: Pieces, run: Callable, done: Callable[[int, float], bool], most: int | None) -> int | None:
    """The first round whose measure over all pieces is ``done``; None if none of ``most`` is. Twice as many rounds are tried each time."""
    tried, n = 0, 24
    while most is None or tried < most:
        n = n if most is None else min(n, most)
        found = cut.measured(run, n)
        for i in range(1, n + 1):
            if done(i, found.get(i, 0.0)):
                return i
        tried, n = n, n * 2
    return None


class Local:
    """The edges of a piece over nodes numbered in the order of their ids."""

    def __init__(self, src: np.ndarray, dst: np.ndarray) -> None:
        self.ids, at = np.unique(np.concatenate((src, dst)), return_inverse=True)
        self.n = len(self.ids)
        self.s, self.d = at[: len(src)], at[len(src) :]

    def simple(self) -> tuple[np.ndarray, np.ndarray]:
        """Both directions of every edge once, without loops, by source."""
        off = self.s != self.d
        s, d = self.s[off], self.d[off]
        key = np.unique(np.concatenate((s * self.n + d, d * self.n + s)))
        return key // self.n, key % self.n

    def directed(self) -> tuple[np.ndarray, np.ndarray]:
        key = np.unique(self.s * self.n + self.d)
        return key // self.n, key % self.n

    def folded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both directions with how many edges there are, a loop twice."""
        key, w = np.unique(np.concatenate((self.s * self.n + self.d, self.d * self.n + self.s)), return_counts=True)
        return key // self.n, key % self.n, w


def starts(n: int, s: np.ndarray) -> np.ndarray:
    """Where each node's edges begin in ``s``, which is sorted; one more entry for the end."""
    return np.concatenate(([0], np.cumsum(np.bincount(s, minlength=n))))


def out_of(begin: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of ``nodes``: (positions among the sorted edges, which of ``nodes`` each is of)."""
    count = begin[nodes + 1] - begin[nodes]
    of = np.repeat(np.arange(len(nodes)), count)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    return begin[nodes][of] + np.arange(len(of)) - first[of], of
