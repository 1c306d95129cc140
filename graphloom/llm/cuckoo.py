"""Exact dedup over a cuckoo-filter index of live digests.

Every text has a SHA-256 digest, made inside the JVM. Map tasks first fold their own rows to one entry a
digest; entries are dealt to buckets by digest, and each bucket keeps one cuckoo filter plus the stored content keys of its live entries
(whole digest and byte length). A digest that the filter reports is verified against the bucketed content: only an equal key is a copy,
anything else is a false hit and is inserted too. Of equal texts the largest doc_id lives: when a larger
one arrives the old live entry is deleted from the filter and the new one inserted. When an insertion finds
no free slot the filter doubles and is refilled from the stored keys.

Two texts count as equal when their SHA-256 digests and byte lengths are equal. A null text counts as empty. A very long text is
digested inside the JVM and never reaches Python. A null doc_id is smaller than all others. Rows that repeat a doc_id and a text count
each in ``group_size``; each of them, ties on the largest doc_id included, is kept if its doc_id is the group's largest. An empty table
gives no rows. Extra columns, whatever their names, are left out of the result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Slots of a bucket of the filter, evictions tried before the filter grows, buckets at the start.
SLOTS, KICKS, START = 4, 200, 256
#: Entries folded in memory before a map task hands them on.
FOLD_ROWS = 200_000
#: Digests that a bucket's task indexes, about: some 400 bytes each.
BUCKET_ROWS = 200_000


class CuckooFilter:
    """Partial-key cuckoo filter over 64-bit hashes with 16-bit fingerprints; false hits, no false misses."""

    def __init__(self, buckets: int = START) -> None:
        self.size = 1 << (buckets - 1).bit_length()
        self.table = array("H", bytes(2 * SLOTS * self.size))  # 0 is a free slot
        self.count = 0
        self._turn = 0

    def _places(self, key: int) -> tuple[int, int, int]:
        mark = (key >> 48) or 1
        first = key & (self.size - 1)
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & (self.size - 1)

    def _put(self, place: int, mark: int) -> bool:
        for at in range(place * SLOTS, place * SLOTS + SLOTS):
            if not self.table[at]:
                self.table[at] = mark
                self.count += 1
                return True
        return False

    def __contains__(self, key: int) -> bool:
        mark, one, two = self._places(key)
        return mark in self.table[one * SLOTS : one * SLOTS + SLOTS] or mark in self.table[two * SLOTS : two * SLOTS + SLOTS]

    def insert(self, key: int) -> bool:
        """False if no slot came free; the filter then lacks one mark and must be rebuilt larger."""
        mark, one, two = self._places(key)
        if self._put(one, mark) or self._put(two, mark):
            return True
        place = one
        for _ in range(KICKS):
            self._turn = (self._turn + 1) % SLOTS
            at = place * SLOTS + self._turn
            mark, self.table[at] = self.table[at], mark
            place = self._other(place, mark)
            if self._put(place, mark):
                return True
        return False

    def delete(self, key: int) -> bool:
        """Removes one copy of the key's mark; only for keys that were inserted."""
        mark, one, two = self._places(key)
        for place in (one, two):
            for at in range(place * SLOTS, place * SLOTS + SLOTS):
                if self.table[at] == mark:
                    self.table[at] = 0
                    self.count -= 1
                    return True
        return False


class LiveIndex:
    """The filter with its stored content keys: key hash -> {(digest, bytes): [live doc_id, rows]}."""

    def __init__(self) -> None:
        self.filter = CuckooFilter()
        self.content: dict[int, dict[tuple[bytes, int], list]] = {}
        self.grown = 0

    def _insert(self, key: int) -> None:
        """Inserts the key of an entry that is stored already; overflow refills ever larger filters until every stored key is in one."""
        if self.filter.insert(key):
            return
        size = self.filter.size
        while True:
            self.grown += 1
            size *= 2
            bigger = CuckooFilter(size)
            if all(bigger.insert(k) for k, held in self.content.items() for _ in held):
                self.filter = bigger
                return

    def add(self, digest: bytes, size: int, doc: int | None, rows: int) -> None:
        key = int.from_bytes(digest[:8], "little")
        held = self.content.get(key, {}).get((digest, size)) if key in self.filter else None
        if held is None:
            self.content.setdefault(key, {})[(digest, size)] = [doc, rows]
            self._insert(key)
            return
        held[1] += rows
        if doc is not None and (held[0] is None or doc > held[0]):
            self.filter.delete(key)
            held[0] = doc
            self._insert(key)

    def remove(self, digest: bytes, size: int) -> bool:
        """Deletes a live digest; False if it isn't there."""
        key = int.from_bytes(digest[:8], "little")
        if key not in self.filter or (digest, size) not in self.content.get(key, {}):
            return False
        self.filter.delete(key)
        del self.content[key][(digest, size)]
        if not self.content[key]:
            del self.content[key]
        return True

    def rows(self) -> Iterator[tuple[bytes, int, int | None, int]]:
        for held in self.content.values():
            for (digest, size), (doc, rows) in held.items():
                yield digest, size, doc, rows


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    by = ["digest", "size"]

    def folded() -> pd.DataFrame:
        whole = pd.concat(held)
        return whole.groupby(by, as_index=False, sort=False).agg(doc_id=("doc_id", "max"), rows=("rows", "sum"))

    n = 0
    for batch in batches:
        held.append(batch.assign(rows=1, doc_id=batch["doc_id"].astype("Int64")))
        n += len(batch)
        if n >= FOLD_ROWS:
            held[:] = [folded()]
            if len(held[0]) > FOLD_ROWS // 2:
                yield held.pop()
            n = len(held[0]) if held else 0
    if held:
        yield folded()


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    index = LiveIndex()
    for batch in batches:
        docs = batch["doc_id"].astype("Int64")
        for digest, size, doc, rows in zip(batch["digest"], batch["size"], docs, batch["rows"], strict=True):
            index.add(bytes(digest), int(size), None if doc is pd.NA else int(doc), int(rows))
    out: list[tuple] = []
    for row in index.rows():
        out.append(row)
        if len(out) >= 20_000:
            yield _frame(out)
            out = []
    if out:
        yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["digest", "size", "doc_id", "rows"])
    return out.assign(doc_id=out["doc_id"].astype("Int64"))


ENTRY = "digest binary, size long, doc_id long, rows long"


def digests(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def groups(rows: DataFrame) -> DataFrame:
    """``doc_id, sha (hex), size`` -> one row a distinct text: ``sha, size, keep_id, group_size``.

    Entries are dealt to as many buckets as the counted rows need, so that a task's filter and keys stay within bounds.
    """
    own = rows.select(F.unhex("sha").alias("digest"), "size", "doc_id")
    buckets = max(16, -(-rows.count() // BUCKET_ROWS))
    entries = own.mapInPandas(_fold, ENTRY).repartition(buckets, "digest")
    live = entries.mapInPandas(_index, ENTRY)
    return live.select(
        F.lower(F.hex("digest")).alias("sha"), "size", F.col("doc_id").alias("keep_id"), F.col("rows").alias("group_size")
    )


def marked(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs`` (doc_id, text).

    Only groups of two rows or more are joined back: a single row answers for itself.
    """
    rows = stored(
        docs.select("doc_id", digests(F.col("text")).alias("sha"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size")),
        "digests",
    )
    several = groups(rows).where(F.col("group_size") > 1).withColumnRenamed("sha", "s").withColumnRenamed("size", "z")
    joined = rows.join(several, (F.col("sha") == F.col("s")) & (F.col("size") == F.col("z")), "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
