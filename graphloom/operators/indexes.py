"""Named text and vector indexes of a catalogue's node tables: made, asked, kept up, shown and dropped by table and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..graph import GraphCatalogue, GraphError
from ..storage import forget
from . import fts, vectors

FTS, VECTOR = "FTS", "VECTOR"


def _table(c: GraphCatalogue, table: str) -> DataFrame:
    if table not in c.node_tables:
        raise GraphError(f"Table {table} does not exist")
    return c.node_tables[table]


def _columns(rows: DataFrame, table: str, columns: list[str]) -> None:
    for name in columns:
        if name not in rows.columns:
            raise GraphError(f"Table {table} has no property {name}")


def create_fts_index(c: GraphCatalogue, table: str, name: str, columns: list[str], config: fts.FtsConfig | None = None) -> None:
    """Indexes the string ``columns`` of a node table under ``name``."""
    rows = _table(c, table)
    _columns(rows, table, columns)
    c.free_index_name(table, name)
    c.indexes[table, name] = FTS, (fts.build(rows, columns, config), list(columns))


def query_fts_index(
    c: GraphCatalogue, table: str, name: str, text: str, k: float = 1.2, b: float = 0.75, conjunctive: bool = False, top: int | None = None
) -> DataFrame:
    index, _ = c.index(table, name, FTS)
    return fts.query(index, text, k, b, conjunctive, top)


def create_vector_index(
    c: GraphCatalogue, table: str, name: str, column: str, metric: str = "cosine", quantization: str = "none", rerank: bool = True, lists: int = 64
) -> None:
    """An inverted file over ``column``, or with a quantisation stored codes that are searched whole."""
    rows = _table(c, table)
    _columns(rows, table, [column])
    c.free_index_name(table, name)
    own = rows.select("id", column)
    index = vectors.ivf(own, column, lists, metric, keep=True) if quantization == "none" else vectors.quantized(own, column, metric, quantization, rerank, keep=True)
    c.indexes[table, name] = VECTOR, (index, [column])


def query_vector_index(c: GraphCatalogue, table: str, name: str, vector, k: int, probes: int = 8, keep: Column | None = None) -> DataFrame:
    """``id, distance`` of the k nearest; with ``keep`` only rows of the node table that it passes, found by an exact scan."""
    index, columns = c.index(table, name, VECTOR)
    if keep is not None:
        return vectors.knn(_table(c, table), columns[0], vector, k, index.metric, keep)
    return index.search(vector, k, probes) if isinstance(index, vectors.IvfIndex) else index.search(vector, k)


def drop_index(c: GraphCatalogue, table: str, name: str, kind: str) -> None:
    """Forgets an index and its stored tables."""
    index, _ = c.index(table, name, kind)
    del c.indexes[table, name]
    forget(_table(c, table).sparkSession, index.paths)


def drop_fts_index(c: GraphCatalogue, table: str, name: str) -> None:
    drop_index(c, table, name, FTS)


def drop_vector_index(c: GraphCatalogue, table: str, name: str) -> None:
    drop_index(c, table, name, VECTOR)


def put_rows(c: GraphCatalogue, table: str, rows: DataFrame) -> None:
    """Inserts rows of a node table, those with a known id replace it, and brings its indexes up to date."""
    old = _table(c, table)
    c.node_tables[table] = old.join(rows.select("id"), "id", "left_anti").select(*old.columns).unionByName(rows.select(*old.columns))
    _each(c, table, lambda kind, index, columns: index.with_rows(rows, columns) if kind == FTS else index.with_rows(rows))


def delete_rows(c: GraphCatalogue, table: str, ids: DataFrame) -> None:
    """Deletes the rows of ``ids`` (``id``) from a node table and from its indexes."""
    c.node_tables[table] = _table(c, table).join(ids.select("id"), "id", "left_anti")
    _each(c, table, lambda kind, index, columns: index.without(ids))


def _each(c: GraphCatalogue, table: str, change) -> None:
    for (t, name), (kind, (index, columns)) in list(c.indexes.items()):
        if t == table:
            c.indexes[t, name] = kind, (change(kind, index, columns), columns)
            forget(c.node_tables[table].sparkSession, index.paths)
