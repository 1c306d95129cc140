"""N-gram Jaccard join by set-relation skipping.

A text's set is its distinct five-word shingles. Two texts link at a Jaccard similarity of 0.8 or more.

1. Every text gives its set's size and a 128-bit fingerprint; sets of equal fingerprints are one node from here on. The same pass
   counts all shingles into a table of fixed size, whose excess over the mean orders frequent shingles last. The table is wide
   enough to tell a shingle whose list would be long from chance: else passages that unrelated texts share would chain them.
2. Every set sends its prefix (as many shingles as it can't all miss in a partner) to index lists dealt by
   shingle. Lists are ordered by size; pairs are bounded by size and by position in both sets. A list of more than
   ``SHORT_LIST`` sets is only chained by size, never paired, and by the tasks that read the texts if it is long there already. Pairs of short lists whose parity bitmaps (one bit a
   hash class) differ in more places than linked sets can are cut. The components of these edges hold every link.
3. Within a component's sets, leaders are indexed; lists are kept in blocks by position, and a block whose bound
   fails is skipped. Sets whose keys most others hold come first, so that a text leads its near copies; else copies that
   differ among themselves would lead themselves, and meet pairwise. A set that links to a leader derives its answers from the
   leader's: a set connected with the leader skips all members, and by the triangle inequality of the Jaccard distance
   only members far enough from their leader are compared with others. A component too large for a task is dealt in parts; then the parts'
   leaders meet, and only members of leaders whose distance leaves a link open are compared across parts, with all lone leaders at once.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; a text of fewer than five words is one shingle, one without
words has an empty set and links with nothing. A text longer than a chunk is taken in pieces. Null texts count as empty. Rows without a doc_id
link like others; they are ignored in a component's least id, which is null if no row has one. Rows that repeat share a component, ties on
the least id mean nothing to it. An empty table gives no rows. Shingles are compared by 60-bit keys. :func:`join` leaves extra columns out,
:func:`keep_one` passes them through, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.components import components

from .common import U64, forget, lean_batches, lowered, mix, stored, text_chunks, trim
from .common import words as chunk_words

WORDS = 5
PERCENT = 80
#: Cells of the table of counts (4 bytes each in a task, packed before they are stored, summed over all documents; one byte each is broadcast).
CELL_BITS = 22
CELLS = 1 << CELL_BITS
#: Bytes of a bucket of index lists and of a bin of sets, about.
BUCKET_BYTES, BIN_BYTES = 6 << 20, 8 << 20
#: A component whose sets take more than this is compared in parts, then by the parts' leaders.
GIANT_BYTES = 24 << 20
#: Rows of a (doc, set, component) table that are broadcast at most; beyond, texts are shuffled to it.
BROADCAST_ROWS = 400_000
#: Lists up to this long are paired under the position bound; longer ones are chained by size.
SHORT_LIST = 128
#: Ranges of the table of counts that are folded apart, and shares in which a range is folded first.
RANGES, FOLDS = 64, 16
#: Postings that a task holds at most, about, and bytes of text that it works on at a time.
FLUSH_POSTINGS, STEP_BYTES = 150_000, 1 << 18

FOLD = lowered()
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
STEPS = mix(np.arange(11, 11 + WORDS, dtype=U64)) | U64(1)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    n = len(offs) - 1
    starts, _, words = chunk_words(data, offs, IS_WORD, FOLD)
    edge = np.searchsorted(starts, offs)
    whole = np.zeros(max(len(words) - WORDS + 1, 0), dtype=U64)
    for i in range(WORDS):
        whole += words[i : len(whole) + i] * STEPS[i]
    whole = mix(whole)
    out = []
    for d in range(n):
        a, b = int(edge[d]), int(edge[d + 1])
        if b - a >= WORDS:
            s = np.sort(whole[a : b - WORDS + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(mix((words[a:b] * STEPS[: b - a]).sum(keepdims=True) + U64(b - a)))
        else:
            out.append(np.empty(0, U64))
    return out


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and two order-free 64-bit fingerprints of each set."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    one, two = np.zeros(len(sets), dtype=np.int64), np.zeros(len(sets), dtype=np.int64)
    if sizes.sum():
        flat = np.concatenate(sets)
        full = np.flatnonzero(sizes)
        at = (np.cumsum(sizes) - sizes)[full]
        one[full] = np.add.reduceat(mix(flat ^ U64(0xA5A5A5A5)), at).view(np.int64)
        two[full] = np.bitwise_xor.reduceat(mix(flat + U64(0x77777777)), at).view(np.int64)
    return sizes, one, two


def parities(sets: list[np.ndarray]) -> list[bytes]:
    """A bitmap for each set: the parity of its shingles in as many hash classes as the set has shingles, about.

    Two sets differ in at least as many shingles as their bitmaps in bits.
    """
    out = []
    for s in sets:
        bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
        odd = np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(bool)).tobytes())
    return out


def bits_apart(a: bytes, b: bytes) -> int:
    """In how many bits two parity bitmaps differ, the larger folded to the size of the smaller."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def levels(counts: np.ndarray, mean: float) -> np.ndarray:
    """How far a cell's count stands out from the mean of all cells: 0 for chance, to 15. A few cells in a hundred do by chance, which only orders them later."""
    over = (counts - mean) / (2 * math.sqrt(mean) + 8)
    return np.where(over < 1, 0, np.minimum(15, 1 + np.log2(np.maximum(over, 1)))).astype(np.uint8)


def keyed(hashes: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Sorted keys: frequent shingles last, else by hash."""
    return np.unique((level[(hashes >> U64(64 - CELL_BITS)).astype(np.int64)].astype(U64) << U64(60)) | (hashes >> U64(4)))


def prefix(n: int, percent: int = PERCENT) -> int:
    """So many first keys a set shares one of with any partner at that similarity."""
    return n - (percent * n + 99) // 100 + 1


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, hash, n, fp, fp2, parity`` a row of ``docs`` (doc_id, hash, text); rows with ``counts`` hold a range (``part``) of a task's table of shingle counts instead."""
    names = ["doc_id", "hash", "n", "fp", "fp2", "parity", "part", "salt", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        counts = np.zeros(CELLS, dtype=np.uint32)
        seen = 0
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column(2), STEP_BYTES):
                sets = shingle_sets(data, offs)
                n, one, two = fingerprints(sets)
                for s in sets:
                    np.add.at(counts, (s >> U64(64 - CELL_BITS)).astype(np.int64), 1)
                seen ^= int(one[0])
                head = batch.slice(lo, hi - lo)
                rest = [pa.nulls(hi - lo, k) for k in kinds[6:]]
                yield pa.RecordBatch.from_arrays([head.column(0), head.column(1), pa.array(n), pa.array(one), pa.array(two), pa.array(parities(sets), pa.binary()), *rest], names)
        salt = pa.array([seen % FOLDS] * RANGES, pa.int32())
        tables = pa.array([packed(x) for x in np.split(counts, RANGES)], pa.binary())
        yield pa.RecordBatch.from_arrays([*[pa.nulls(RANGES, k) for k in kinds[:6]], pa.array(np.arange(RANGES, dtype=np.int32)), salt, tables], names)

    return docs.mapInArrow(own, "doc_id long, hash long, n long, fp long, fp2 long, parity binary, part int, salt int, counts binary")


def packed(counts: np.ndarray) -> bytes:
    """A range of counts in the narrowest type that holds them, compressed: a byte or less a cell that one task has counted."""
    return zlib.compress(counts.astype(np.min_scalar_type(counts.max())), 1)


def unpacked(cell: bytes) -> np.ndarray:
    raw = zlib.decompress(cell)
    return np.frombuffer(raw, dtype=f"u{len(raw) * RANGES // CELLS}")


def standing_out(measured: DataFrame, shingles: int) -> np.ndarray:
    """The level of each cell of the summed tables. Every range of cells is folded on its own, in ``FOLDS`` shares first; a byte a cell comes back."""
    mean = shingles / CELLS

    def summed(batches: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x in zip(batch["part"], batch["counts"], strict=True):
                if part not in total:
                    total[part] = np.zeros(CELLS // RANGES, dtype=np.uint64)
                total[part] += unpacked(x)
        return total

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(p, packed(t)) for p, t in summed(batches).items()], columns=["part", "counts"])

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(p, levels(t, mean).tobytes()) for p, t in summed(batches).items()], columns=["part", "levels"])

    tables = measured.where(F.col("counts").isNotNull()).select("part", "salt", "counts").repartition("part", "salt").mapInPandas(fold, "part int, counts binary")
    found = tables.repartition("part").mapInPandas(level, "part int, levels binary").collect()  # RANGES rows, CELLS bytes in all
    out = np.zeros(CELLS, dtype=np.uint8)
    for r in found:
        width = CELLS // RANGES
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["levels"], dtype=np.uint8)
    return out


#: An entry of an index list: shingle key, the set's two fingerprints, its size, the key's position, whether the list is chained.
POSTING = np.dtype([("key", "<u8"), ("fp", "<i8"), ("fp2", "<i8"), ("n", "<u4"), ("at", "<u4"), ("hot", "u1")])
#: A chain's edge: two sets by their fingerprints.
CHAIN = np.dtype([("a", "<i8"), ("a2", "<i8"), ("b", "<i8"), ("b2", "<i8")])


def thinned(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A task's postings, its long lists chained here by size: (postings that go on, edges of the chains).

    Of a chained list only so many sets go on that each stands within a link's size of the next: a set of another task that
    falls between two of them meets the smaller, so the chains of all tasks hang together as the whole list's chain would.
    """
    flat = flat[np.lexsort((flat["fp2"], flat["fp"], flat["n"], flat["key"]))]
    fresh = np.append(True, flat["key"][1:] != flat["key"][:-1])
    start = np.flatnonzero(fresh)
    size = np.diff(np.append(start, len(flat)))
    keep = np.ones(len(flat), dtype=bool)
    edges = []
    for a, k in zip(start[size > SHORT_LIST].tolist(), size[size > SHORT_LIST].tolist(), strict=True):
        own = flat[a : a + k]
        n = own["n"].astype(np.int64)
        linked = np.flatnonzero(100 * n[:-1] >= PERCENT * n[1:])
        e = np.empty(len(linked), dtype=CHAIN)
        e["a"], e["a2"], e["b"], e["b2"] = own["fp"][linked], own["fp2"][linked], own["fp"][linked + 1], own["fp2"][linked + 1]
        edges.append(e)
        some, i = [0], 0
        while i < k - 1:
            i = max(i + 1, int(np.searchsorted(n, 100 * n[i] // PERCENT, side="right")) - 1)
            some.append(i)
        flat["hot"][a : a + k] = 1
        keep[a : a + k] = False
        keep[a + np.array(some)] = True
    chains = np.unique(np.concatenate(edges)) if edges else np.empty(0, CHAIN)
    return flat[keep], chains


def posted(docs: DataFrame, level: np.ndarray, buckets: int) -> tuple[DataFrame, Broadcast]:
    """Prefix postings packed by bucket, and chain edges of lists that are long in one task already; with the broadcast that the rows need."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        seen: set[tuple[int, int]] = set()  # the sets of one input partition
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            postings, chains = thinned(np.concatenate(held))
            cells: list[list] = [[], [], []]
            for column, flat, key in ((1, postings, postings["key"]), (2, chains, chains["a"].view(U64))):
                bucket = (key % U64(buckets)).astype(np.int32)
                flat, bucket = flat[order := np.argsort(bucket, kind="stable")], bucket[order]
                edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]).tolist()
                for a, b in zip(edge, [*edge[1:], len(flat)][: len(edge)], strict=True):
                    cells[0].append(bucket[a])
                    cells[column].append(flat[a:b].tobytes())
                    cells[3 - column].append(None)
            return pa.RecordBatch.from_arrays(
                [pa.array(cells[0], pa.int32()), pa.array(cells[1], pa.binary()), pa.array(cells[2], pa.binary())], ["bucket", "cells", "chains"]
            )

        for batch in batches:
            for _, _, data, offs in text_chunks(batch.column(0), STEP_BYTES):
                sets = shingle_sets(data, offs)
                n, one, two = fingerprints(sets)
                for s, size_, fp, fp2 in zip(sets, n.tolist(), one.tolist(), two.tolist(), strict=True):
                    if not size_ or (fp, fp2) in seen:  # an equal set of this task has sent the same
                        continue
                    seen.add((fp, fp2))
                    keys = keyed(s, shared.value)[: prefix(size_)]
                    cell = np.zeros(len(keys), dtype=POSTING)
                    cell["key"], cell["fp"], cell["fp2"], cell["n"], cell["at"] = keys, fp, fp2, size_, np.arange(len(keys))
                    held.append(cell)
                    size += len(cell)
                if size >= FLUSH_POSTINGS:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(own, "bucket int, cells binary, chains binary"), shared


PAIR = "src long, src2 long, dst long, dst2 long, chain long"


def connect(group: pa.Table) -> pa.Table:
    """Edges that connect the sets of each index list which may link; all steps are over whole columns."""
    trim()
    flat = np.concatenate([np.empty(0, POSTING), *[np.frombuffer(x, dtype=POSTING) for x in group.column("cells").to_pylist() if x is not None]])
    chains = np.concatenate([np.empty(0, CHAIN), *[np.frombuffer(x, dtype=CHAIN) for x in group.column("chains").to_pylist() if x is not None]])
    keys = np.sort(flat["key"])
    twice = np.unique(keys[1:][keys[1:] == keys[:-1]])
    at = np.searchsorted(twice, flat["key"])
    at[at == len(twice)] = 0
    flat = flat[twice[at] == flat["key"]] if len(twice) else flat[:0]
    # the bucket's sets by a number of their own
    order = np.lexsort((flat["fp2"], flat["fp"]))
    one, two = flat["fp"][order], flat["fp2"][order]
    fresh = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)]
    name = np.empty(len(flat), dtype=np.int64)
    name[order] = np.cumsum(fresh) - 1
    one, two = one[fresh], two[fresh]
    order = np.lexsort((name, flat["n"], flat["key"]))
    flat, name = flat[order], name[order]
    first = np.ones(len(flat), dtype=bool)  # equal sets of several tasks are one entry
    first[1:] = (flat["key"][1:] != flat["key"][:-1]) | (name[1:] != name[:-1])
    flat, name = flat[first], name[first]
    run = np.cumsum(np.append(True, flat["key"][1:] != flat["key"][:-1])) - 1 if len(flat) else np.empty(0, np.int64)
    long = (np.bincount(run) > SHORT_LIST) | (np.bincount(run, flat["hot"]) > 0) if len(flat) else np.empty(0, bool)
    n, pos = flat["n"].astype(np.int64), flat["at"].astype(np.int64)
    found = [np.empty(0, np.int64)]
    left = np.arange(len(flat))
    width = len(one)
    for lag in range(1, SHORT_LIST):
        # entries whose list goes on for so many more, and whose partner isn't too large; partners only grow
        left = left[left + lag < len(flat)]
        left = left[run[left] == run[left + lag]]
        left = left[100 * n[left] >= PERCENT * n[left + lag]]
        if not len(left):
            break
        right = left + lag
        need = -(-PERCENT * (n[left] + n[right]) // (100 + PERCENT))
        bound = np.minimum(n[left] - pos[left], n[right] - pos[right]) >= need
        chained = long[run[left]]
        ok = np.where(chained, lag == 1, bound)
        a, b = name[left[ok]], name[right[ok]]
        found.append((np.minimum(a, b) * width + np.maximum(a, b)) * 2 + chained[ok])
        if lag == 1:
            left = left[~chained]
    pairs = np.unique(np.concatenate(found))
    a, b, chain = pairs // 2 // max(width, 1), pairs // 2 % max(width, 1), pairs % 2
    cols = [np.concatenate((x[i], chains[k])) for x, i, k in ((one, a, "a"), (two, a, "a2"), (one, b, "b"), (two, b, "b2"))]
    return pa.table({"src": cols[0], "src2": cols[1], "dst": cols[2], "dst2": cols[3], "chain": np.concatenate((chain, np.ones(len(chains), np.int64)))})


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs by their sets' ids, without those that are no chain and whose bitmaps are too far apart for a link."""
    both = pairs.groupBy("src", "src2", "dst", "dst2").agg(F.max("chain").alias("chain"))
    for c in ("src", "dst"):
        end = nodes.select(F.col("fp").alias(c), F.col("fp2").alias(f"{c}2"), F.col("id").alias(f"id_{c}"), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"))
        both = both.join(end, [c, f"{c}2"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst, chain, n, m, p, q = (batch.column(i) for i in range(7))
            total = n.to_numpy() + m.to_numpy()
            most = (total - 2 * -(-PERCENT * total // (100 + PERCENT))).tolist()
            keep = [c or bits_apart(x, y) <= d for c, x, y, d in zip(chain.to_pylist(), p.to_pylist(), q.to_pylist(), most, strict=True)]
            made = pa.RecordBatch.from_arrays([src, dst], ["src", "dst"])
            yield made.filter(pa.array([bool(k) for k in keep], pa.bool_()))

    return both.select("id_src", "id_dst", "chain", "n_src", "n_dst", "p_src", "p_dst").mapInArrow(own, "src long, dst long")


def overlap(n: int, m: int, percent: int) -> int:
    """Keys that sets of these sizes share at least at that similarity."""
    return -(-percent * (n + m) // (100 + percent))


class Blocks:
    """Index lists of sets, in blocks by position; a block keeps the most keys that a set has left there, and its smallest set's size."""

    def __init__(self) -> None:
        self.lists: dict[int, dict[int, list]] = {}

    def add(self, keys: list[tuple[int, int]], size: int, name: int) -> None:
        for at, key in keys:
            block = self.lists.setdefault(key, {}).setdefault(at.bit_length(), [size - at, size, []])
            block[0], block[1] = max(block[0], size - at), min(block[1], size)
            block[2].append((name, size - at, size))

    def reach(self, keys: list[tuple[int, int]], size: int, percent: int) -> Iterator[int]:
        """Sets that may be so similar to one of that size and those first keys; the overlap can't exceed what is left of either set."""
        for at, key in keys:
            for most, least, entries in self.lists.get(key, {}).values():
                if min(most, size - at) >= overlap(size, least, percent):
                    yield from (name for name, left, n in entries if min(left, size - at) >= overlap(size, n, percent))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Keys that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def holdings(sets: list[np.ndarray]) -> list[np.ndarray]:
    """For each set, how many of the sets hold each of its keys."""
    if not sets:
        return []
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    return np.split(times[at], np.cumsum([len(s) for s in sets])[:-1])


def met_keys(keys: np.ndarray, held: np.ndarray, first: int) -> list[tuple[int, int]]:
    """Positions and keys among so many first ones, without those that no other set has."""
    at = np.flatnonzero(held[:first] > 1)
    return list(zip(at.tolist(), keys[at].tolist(), strict=True))


def local_links(sets: list[np.ndarray]) -> tuple[list[int], list[tuple[int, float]]]:
    """Index of a root for each set (sets that links connect have the same), and its leader with the distance to it.

    Exact; see the module's step 3. Every member of a leader links to it.
    """
    slack = (100 - PERCENT) / 100
    root = list(range(len(sets)))
    led = [(i, 0.0) for i in range(len(sets))]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    index = Blocks()
    members: dict[int, Blocks] = {}
    holders: dict[int, set[int]] = {}  # for a key, the leaders whose members have it in their prefix
    held = holdings(sets)
    # the text that a group's near copies were made from has the keys that most of them hold: first, it leads them all
    for x in sorted(range(len(sets)), key=lambda i: -held[i].sum() / max(len(sets[i]), 1)):
        n = len(sets[x])
        if not n:
            continue
        known: dict[int, tuple[bool, float]] = {}

        def apart(y: int) -> tuple[bool, float]:
            if y not in known:
                both = common(sets[x], sets[y])  # noqa: B023
                union = n + len(sets[y]) - both  # noqa: B023
                known[y] = (100 * both >= PERCENT * union, 1 - both / union)  # noqa: B023
            return known[y]  # noqa: B023

        first = met_keys(sets[x], held[x], prefix(n))
        best = None
        for y in index.reach(first, n, PERCENT):
            if find(y) != find(x) and apart(y)[0]:
                root[find(x)] = find(y)
                if best is None or apart(y)[1] < best[0]:
                    best = (apart(y)[1], y)
        for y in sorted(set().union(*(holders[k] for _, k in first if k in holders))):
            if find(y) == find(x):
                continue  # all members of a leader are connected
            for z in members[y].reach(first, n, PERCENT):
                if led[z][1] + 1e-9 >= apart(y)[1] - slack and apart(z)[0]:
                    root[find(x)] = find(z)
                    break
        if best is None:
            index.add(first, n, x)
        else:
            led[x] = (best[1], best[0])
            members.setdefault(best[1], Blocks()).add(first, n, x)
            for _, key in first:
                holders.setdefault(key, set()).add(best[1])
    return [find(x) for x in range(len(sets))], led


def open_leaders(sets: list[np.ndarray], parts: list[int], radius: list[float]) -> list[tuple[int, int, float | None]]:
    """Pairs of leaders of different parts that link (distance None), or whose members may: (one, other, distance)."""
    slack = (100 - PERCENT) / 100
    # no member is farther than a link from its leader, so members of both can link up to 3 times that, of one up to twice, and lone leaders only themselves
    near = [100 - k * (100 - PERCENT) for k in (1, 2, 3)]
    index, out = {(kind, share): Blocks() for kind in (0, 1) for share in near[kind : kind + 2]}, []
    held = holdings(sets)
    for x in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        n, kind = len(sets[x]), int(radius[x] > 0)
        for other in (0, 1):
            share = near[kind + other]
            first = met_keys(sets[x], held[x], prefix(n, share))
            for y in set(index[other, share].reach(first, n, share)):
                if parts[x] == parts[y]:
                    continue
                both = common(sets[x], sets[y])
                union = n + len(sets[y]) - both
                distance = 1 - both / union
                if 100 * both >= PERCENT * union:
                    out.append((x, y, None))
                elif distance <= slack + radius[x] + radius[y] + 1e-9:
                    out.append((x, y, distance))
        for share in near[kind : kind + 2]:
            index[kind, share].add(met_keys(sets[x], held[x], prefix(n, share)), n, x)
    return out


def by_block(group: pa.Table) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """For each component in a bin: rows, sets' ids and keys; rows that repeat count once."""
    blocks, names = group.column("block").to_numpy(), group.column("id").to_numpy()
    cells = group.column("keys").to_pylist()
    for rows in np.split(order := np.argsort(blocks, kind="stable"), np.flatnonzero(np.diff(blocks[order])) + 1):
        own = dict(zip(names[rows].tolist(), rows.tolist(), strict=True))
        ids = sorted(own)
        yield [own[f] for f in ids], ids, [np.frombuffer(cells[own[f]], dtype=U64) for f in ids]


LINK = "src long, dst long, apart double, block long, part int"


def links_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32())
    cols = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.table({n.split()[0]: pa.array(c, k) for n, c, k in zip(LINK.split(", "), cols, kinds, strict=True)})


def joined(group: pa.Table) -> pa.Table:
    """Links of the sets of each component in a bin: ``src`` (set), ``dst`` (its root's set).

    For sets of a part also ``src`` (set), ``dst`` (its leader), ``apart``, ``block`` and ``part``.
    """
    trim()
    parts, out = group.column("part").to_pylist(), []
    blocks = group.column("block").to_pylist()
    for rows, ids, sets in by_block(group):
        roots, led = local_links(sets)
        for i, (r, (leader, apart)) in enumerate(zip(roots, led, strict=True)):
            if r != i:
                out.append((ids[i], ids[r], None, None, None))
            if parts[rows[i]] is not None:
                out.append((ids[i], ids[leader], apart, blocks[rows[i]], parts[rows[i]]))
    return links_table(out)


def met(group: pa.Table) -> pa.Table:
    """Leaders of a component that link across parts, or (with ``apart``) whose members may."""
    parts, radius, out = group.column("part").to_pylist(), group.column("radius").to_pylist(), []
    for rows, ids, sets in by_block(group):
        for x, y, apart in open_leaders(sets, [parts[r] for r in rows], [radius[r] for r in rows]):
            out.append((ids[x], ids[y], apart, None, None))
    return links_table(out)


def linked(docs: DataFrame) -> DataFrame:
    """``doc_id, hash, n, component_id, keeper`` for every row of ``docs`` (doc_id, text).

    ``hash`` is the text's; ``keeper`` (struct of unnamed, doc_id, hash) names the row that stands for the group: null in groups of one row.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    done: list[str] = []
    sent: list[Broadcast] = []
    save = lambda df, name: stored(df, name, done)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    measured = save(measure(docs), "sets")
    own = measured.where(F.col("counts").isNull()).drop("counts", "part", "salt")
    shingles = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    level = standing_out(measured, shingles)
    buckets = max(32, int(shingles * (100 - PERCENT) / 100 * POSTING.itemsize / BUCKET_BYTES) + 1)
    # a set goes by the row of the least doc_id that has it, rows without one last
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")
    nodes = own.where("n > 0").groupBy("fp", "fp2").agg(F.min(row).alias("row"), F.min("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.first("parity").alias("parity"))
    nodes = save(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    lists, broadcast = posted(docs, level, buckets)
    sent.append(broadcast)
    edges = save(plausible(lists.groupBy("bucket").applyInArrow(connect, PAIR), nodes), "candidates")
    blocks = components(edges).select("id", F.col("component").alias("block"))
    wanted = save(nodes.join(blocks, "id").select("id", "fp", "fp2", "block", "row.unnamed", "row.doc_id", "row.hash", "n"), "wanted")
    sized = wanted.groupBy("block").agg(F.sum(F.col("n") * 8 + 64).alias("bytes"))
    some = wanted.agg(F.coalesce(F.sum(F.col("n") * 8 + 64), F.lit(0)).alias("bytes")).first()
    giant = save(sized.where(F.col("bytes") > GIANT_BYTES), "giants")
    n_parts = F.ceil(F.col("bytes") / (GIANT_BYTES // 2)).cast("int")
    some_giant = bool(giant.limit(1).count())
    dealt = wanted.join(giant.select("block", n_parts.alias("parts")), "block", "left").select(*ROW, "block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    bins = int(some["bytes"] / BIN_BYTES) + 1
    own_bin = F.when(F.col("part").isNull(), F.pmod(F.xxhash64("block"), F.lit(bins))).otherwise(F.xxhash64("block", "part"))
    links = save(fetch(docs, dealt, level, save, sent).withColumn("bin", own_bin).groupBy("bin").applyInArrow(joined, LINK), "links")
    if some_giant:
        links = save(across_parts(docs, wanted, links, level, save, sent), "all_links")
        roots = components(links)
    else:
        roots = links.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    # sets of one row alone answer for themselves; only groups of equal sets and linked sets are joined back
    whole = nodes.select("id", "fp", "fp2", "row", "rows").join(roots, "id", "left").withColumn("root", F.coalesce("component", "id"))
    shared = whole.groupBy("root").agg(F.min("row").alias("keeper"), F.sum("rows").alias("rows")).where("rows > 1")
    answer = whole.join(shared.select("root", "keeper"), "root").select("fp", "fp2", "keeper")
    out = own.where("n > 0").join(answer, ["fp", "fp2"], "left").select("doc_id", "hash", "n", "keeper")
    out = out.unionByName(own.where("n = 0").select("doc_id", "hash", "n", F.lit(None).cast(out.schema["keeper"].dataType).alias("keeper")))
    component = F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id"))
    out = stored(out.select("doc_id", "hash", "n", component.alias("component_id"), "keeper"), "components")
    for b in sent:
        b.destroy()
    forget(spark, done)
    return out


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (doc_id, text)."""
    return linked(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


#: What fetching a set takes: its id and fingerprints, and the row that it goes by.
ROW = ("id", "fp", "fp2", "unnamed", "doc_id", "hash")


def across_parts(docs: DataFrame, wanted: DataFrame, links: DataFrame, level: np.ndarray, save, sent: list[Broadcast]) -> DataFrame:
    """``src, dst``: the links within parts, and those that connect the parts of components too large for a task."""
    inner = links.where("apart IS NULL").select("src", "dst")
    members = links.where("apart IS NOT NULL").select(F.col("src").alias("id"), F.col("dst").alias("leader"), "apart", "block", "part")
    leaders = save(members.groupBy("leader", "block", "part").agg(F.max("apart").alias("radius")).withColumnRenamed("leader", "id"), "leaders")
    own = leaders.join(wanted.select(*ROW, "n"), "id")
    size = own.groupBy("block").agg((F.ceil(F.sum(F.col("n") * 8 + 64) / GIANT_BYTES)).cast("int").alias("cells"))
    # leaders are few where sets are alike; where they still fill several tasks, their shares meet pairwise
    share = F.pmod(F.xxhash64("id"), F.col("cells"))
    pair = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda c: F.struct(F.least(c, share).alias("a"), F.greatest(c, share).alias("b")))
    spread = own.join(size, "block").withColumn("cell", F.explode(F.array_distinct(pair)))
    spread = spread.select(*ROW, "block", "part", "radius", F.xxhash64("block", "cell").alias("bin"))
    between = save(fetch(docs, spread, level, save, sent).groupBy("bin").applyInArrow(met, LINK), "between")
    known = inner.unionByName(between.where("apart IS NULL").select("src", "dst"))
    roots = components(known)
    left = between.where("apart IS NOT NULL").select("src", "dst", "apart").distinct()
    for c in ("src", "dst"):
        left = left.join(roots.select(F.col("id").alias(c), F.col("component").alias(f"r_{c}")), c, "left")
        left = left.join(leaders.select(F.col("id").alias(c), F.col("radius").alias(f"radius_{c}")), c)
    left = left.where(F.coalesce("r_src", "src") != F.coalesce("r_dst", "dst"))
    # a leader's members meet all the lone leaders that are open with it at once: one copy of them, not one a pair
    block = F.when(F.col("radius_src") == 0, F.xxhash64("dst")).when(F.col("radius_dst") == 0, F.xxhash64("src")).otherwise(F.xxhash64("src", "dst"))
    left = save(left.select("src", "dst", "apart", "radius_src", "radius_dst", block.alias("block")), "open")
    sides = []
    for mine, other in (("src", "dst"), ("dst", "src")):
        reach = left.select(F.col(mine).alias("leader"), "block", (F.col("apart") - (100 - PERCENT) / 100 - F.col(f"radius_{other}") - 1e-9).alias("least"))
        sides.append(members.select("id", "leader", "apart").join(reach, "leader").where(F.col("apart") >= F.col("least")).select("id", "block"))
    asked = sides[0].unionByName(sides[1]).distinct().join(wanted.select(*ROW), "id")
    asked = asked.select(*ROW, "block", F.lit(None).cast("int").alias("part"), F.col("block").alias("bin"))
    rest = fetch(docs, asked, level, save, sent).groupBy("bin").applyInArrow(joined, LINK).select("src", "dst")
    return known.unionByName(rest)


def fetch(docs: DataFrame, wanted: DataFrame, level: np.ndarray, save, sent: list[Broadcast]) -> DataFrame:
    """``wanted`` (``ROW`` and more) with the keys of the sets instead of the row; a small counted table is broadcast to the texts, else both are shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(level)
    sent.append(shared)
    wanted = save(wanted, "fetched")
    more = [c for c in wanted.columns if c not in ROW]
    columns = ["id", "fp", "fp2", *more]
    small = lambda df: F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("shuffle_hash")
    named = wanted.where("NOT unnamed").drop("unnamed")
    rows = docs.where(F.col("doc_id").isNotNull()).join(small(named), ["doc_id", "hash"]).select(*columns, "text")
    unnamed = wanted.where("unnamed")
    if not unnamed.isEmpty():  # of rows without a doc_id one of each text is taken, folded in the tasks that read them
        keys = save(unnamed.select("hash").distinct(), "unnamed")
        texts = docs.where(F.col("doc_id").isNull()).join(small(keys), "hash").groupBy("hash").agg(F.first("text").alias("text"))
        rows = rows.unionByName(texts.join(unnamed, "hash").select(*columns, "text"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column(len(columns)), STEP_BYTES):
                sets = shingle_sets(data, offs)
                _, one, two = fingerprints(sets)
                part = batch.slice(lo, hi - lo)
                cells = [keyed(s, shared.value).tobytes() for s in sets]
                made = pa.RecordBatch.from_arrays([part.column(0), *part.columns[3 : len(columns)], pa.array(cells, pa.binary())], ["id", *more, "keys"])
                yield made.filter(pa.array((one == part.column(1).to_numpy()) & (two == part.column(2).to_numpy())))

    kinds = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in ("id", *more))
    return rows.mapInArrow(own, f"{kinds}, keys binary")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of linked documents: the one with the least doc_id, rows without one last. Rows without words all stay."""
    found = linked(docs.select("doc_id", "text")).where(F.col("keeper").isNotNull())
    stays = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("hash") == F.col("keeper.hash"))
    known = stored(found.groupBy("doc_id", "hash", stays.alias("stays")).agg(F.count(F.lit(1)).alias("rows")), "copies")
    key, text_hash = F.col("doc_id").cast("long"), F.xxhash64("text")

    def where(kind: str, what: DataFrame) -> DataFrame:
        few = what.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        table = what.select(F.col("doc_id").alias("__doc"), F.col("hash").alias("__hash"))
        return docs.join(F.broadcast(table) if few else table.hint("shuffle_hash"), key.eqNullSafe(table["__doc"]) & (text_hash == table["__hash"]), kind)

    again = known.where("stays AND rows > 1")
    if again.isEmpty():
        return where("left_anti", known.where("NOT stays")).select(*docs.columns)
    # rows that repeat both doc_id and text: any one of them
    one = where("left_semi", again).groupBy(key.alias("__doc"), text_hash.alias("__hash")).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    rest = where("left_anti", known.where("NOT stays OR rows > 1")).select(*docs.columns)
    return rest.unionByName(one.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
