"""Property graphs over DataFrames.

A projected graph is a node table ``id`` (+ properties) and an edge table ``src, dst, rel`` (+ properties). Edges
keep parallel ones and loops; ``simple`` gives the symmetrised simple graph, ``directed`` drops parallel edges alone.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GraphError(ValueError):
    """A graph, parameter or catalogue entry that a call can't use."""


@dataclass(frozen=True)
class ProjectedGraph:
    """Nodes with a unique ``id`` (long) and edges between them."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame, node_filter: Column | None = None, edge_filter: Column | None = None) -> ProjectedGraph:
        """Applies the predicates; an edge stays only between nodes that stay."""
        if "id" not in nodes.columns or not {"src", "dst"} <= set(edges.columns):
            raise GraphError("nodes need a column id, edges need src and dst")
        if node_filter is not None:
            nodes = nodes.where(node_filter)
            ids = nodes.select("id")
            edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        if edge_filter is not None:
            edges = edges.where(edge_filter)
        return ProjectedGraph(nodes, edges)

    @staticmethod
    def from_edges(edges: DataFrame) -> ProjectedGraph:
        """A graph of all end points of ``edges``."""
        ids = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
        return ProjectedGraph(ids, edges)

    def simple(self) -> DataFrame:
        """Both directions of every edge once, without loops: ``src, dst``."""
        e = self.edges.where("src <> dst")
        return e.select("src", "dst").union(e.select(F.col("dst"), F.col("src"))).distinct()

    def directed(self) -> DataFrame:
        """Every directed edge once, loops kept."""
        return self.edges.select("src", "dst").distinct()

    def both_ways(self) -> DataFrame:
        """Every edge in both directions; parallel edges stay, a loop counts twice."""
        return self.edges.select("src", "dst").union(self.edges.select(F.col("dst"), F.col("src")))


@dataclass
class GraphCatalogue:
    """Named graphs, node and edge tables, schemas and indexes of a session."""

    node_tables: dict[str, DataFrame] = field(default_factory=dict)
    edge_tables: dict[str, list[tuple[str, str, DataFrame]]] = field(default_factory=dict)
    projected: dict[str, ProjectedGraph] = field(default_factory=dict)
    schemas: set[str] = field(default_factory=lambda: {"/"})
    indexes: dict[tuple[str, str], tuple[str, object]] = field(default_factory=dict)

    def add_nodes(self, label: str, df: DataFrame) -> None:
        if label in self.node_tables:
            raise GraphError(f"{label} already exists in catalog")
        self.node_tables[label] = df

    def add_edges(self, label: str, source: str, target: str, df: DataFrame) -> None:
        """One endpoint pair of an edge group; several pairs may share a label."""
        for end in (source, target):
            if end not in self.node_tables:
                raise GraphError(f"Table {end} does not exist")
        self.edge_tables.setdefault(label, []).append((source, target, df))

    def project(
        self, name: str, nodes: Mapping[str, Column | None] | list[str], edges: Mapping[str, Column | None] | list[str]
    ) -> ProjectedGraph:
        """A subset of the tables, with a predicate a table. Ids of several labels are told apart by a label column."""
        if name in self.projected:
            raise GraphError(f"Project graph {name} already exists")
        nodes = dict.fromkeys(nodes) if isinstance(nodes, list) else dict(nodes)
        edges = dict.fromkeys(edges) if isinstance(edges, list) else dict(edges)
        parts = []
        for label, keep in nodes.items():
            if label not in self.node_tables:
                raise GraphError(f"Table {label} does not exist")
            df = self.node_tables[label]
            parts.append((df if keep is None else df.where(keep)).withColumn("label", F.lit(label)))
        links = []
        for label, keep in edges.items():
            if label not in self.edge_tables:
                raise GraphError(f"Table {label} does not exist")
            for source, target, df in self.edge_tables[label]:
                for end in (source, target):
                    if end not in nodes:
                        raise GraphError(f"{end} is connected to {label} but not projected.")
                links.append(df if keep is None else df.where(keep))
        all_nodes = parts[0]
        for p in parts[1:]:
            all_nodes = all_nodes.unionByName(p, allowMissingColumns=True)
        all_edges = links[0]
        for e in links[1:]:
            all_edges = all_edges.unionByName(e, allowMissingColumns=True)
        ids = all_nodes.select("id")
        if any(v is not None for v in nodes.values()):
            all_edges = all_edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        self.projected[name] = ProjectedGraph(all_nodes, all_edges)
        return self.projected[name]

    def drop_projected(self, name: str) -> None:
        if name not in self.projected:
            raise GraphError(f"Project graph {name} does not exist")
        del self.projected[name]

    def free_index_name(self, table: str, name: str) -> None:
        if (table, name) in self.indexes:
            raise GraphError(f"Index {name} already exists in table {table}")

    def index(self, table: str, name: str, kind: str):
        """The index of that kind, else an error."""
        if self.indexes.get((table, name), (None,))[0] != kind:
            raise GraphError(f"Table {table} has no {kind} index named {name}")
        return self.indexes[table, name][1]

    def show_indexes(self) -> list[tuple[str, str, str]]:
        """(table, index, kind) of every index."""
        return sorted((t, i, kind) for (t, i), (kind, _) in self.indexes.items())


def register_from_tables(tables: Mapping[str, DataFrame], keys: Mapping[str, str] | None = None) -> tuple[GraphCatalogue, dict[str, str]]:
    """A graph from tables named ``node_*``, ``rel_*`` or ``csr_rel_*``, with the reasons of those left out.

    A node's key is its column ``id``, the one in ``keys``, or its first column. An edge table's columns that start with ``src``
    and ``dst`` or ``dest`` are its ends; ``rel_<name>`` with a suffix ``_<source>_<target>`` names its node tables, else all ends must be of the only one.
    """
    out, skipped = GraphCatalogue(), {}
    for name, df in tables.items():
        if name.startswith("node_"):
            key = (keys or {}).get(name) or ("id" if "id" in df.columns else df.columns[0])
            out.add_nodes(name[5:], df.withColumnRenamed(key, "id"))
    labels = list(out.node_tables)
    for name, df in tables.items():
        if not name.startswith(("rel_", "csr_rel_")):
            if not name.startswith("node_"):
                skipped[name] = "name has no known prefix"
            continue
        src = next((c for c in df.columns if c.lower().startswith("src")), None)
        dst = next((c for c in df.columns if c.lower().startswith(("dst", "dest"))), None)
        if src is None or dst is None:
            skipped[name] = "no source and target columns"
            continue
        pair = next(((a, b) for a in labels for b in labels if name.endswith(f"_{a}_{b}")), None)
        if pair is None and len(labels) != 1:
            skipped[name] = "node tables of its ends can't be told"
            continue
        a, b = pair or (labels[0], labels[0])
        label = name.removeprefix("csr_").removeprefix("rel_").removesuffix(f"_{a}_{b}")
        out.add_edges(label, a, b, df.withColumnRenamed(src, "src").withColumnRenamed(dst, "dst"))
    return out, skipped


def edges_from_csr(indptr: DataFrame, indices: DataFrame) -> DataFrame:
    """Compressed rows to edges: ``indptr`` (node, start) and ``indices`` (position, dst) give ``src, dst, rel``.

    Row extents meet positions by a range of blocks of 1,024 positions, so neither side is ordered as a whole in one task.
    """
    width = 1024
    ends = indptr.select((F.col("node") - 1).alias("node"), F.col("start").alias("stop"))
    rows = indptr.join(ends, "node").where("stop > start")
    blocks = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    at = indices.withColumn("block", F.floor(F.col("position") / width))
    hit = at.join(blocks, "block").where((F.col("position") >= F.col("start")) & (F.col("position") < F.col("stop")))
    return hit.select(F.col("node").alias("src"), "dst", F.col("position").alias("rel"))
