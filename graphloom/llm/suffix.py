"""Suffix-array dedup: repeated byte strings by merging the Burrows-Wheeler transforms of shards.

A byte goes if a string of ``SPAN`` bytes that starts earlier (smaller doc_id, or same document and earlier
byte) equals a string that covers it; strings are judged on the input and never cross documents.

1. Each document is cut into runs of strings that choose the same k-gram (see ``winnow``), so all
   occurrences of a string lie in runs of one k-gram. Of runs with the same bytes only the first can be news: a map task
   settles its own copies before the shuffle, the k-gram's bucket the rest. Runs of a k-gram that stands in many different runs of a
   map task are dealt by their bytes instead, and only a mark goes to the k-gram's bucket, which then passes its own runs of it on
   to meet them by bytes: no task holds all runs of a frequent k-gram.
2. Of k-grams with several different runs, the bytes of each first run are fetched and dealt to bins by k-gram. Runs that
   share no core of a string with another run of their k-gram can't repeat and are left out. A k-gram with very many runs
   is split: a run is cut by the quarter of its strings that the k-gram stands in, and each piece is dealt by that quarter's core.
3. In a bin the runs form two shards. Each shard's suffixes are sorted once and give its transform; the transforms
   are merged by refining the interleave, two symbols a round, with no suffix sorted again. The blocks that stay
   together through ``SPAN`` symbols are the intervals whose common prefix is long enough: repeated strings.
   In each the earliest string stays, the others mark their bytes.

A null text counts as empty. doc_id names a document: rows that repeat it with the same text are one document and get the same answer;
other texts with that doc_id are documents of their own, in the order of a hash of the text. A null doc_id comes before all others and
names nothing: each such row is a document, so of equal ones one stays. Texts shorter than ``SPAN`` bytes, empty ones too, lose nothing; one longer than a chunk is cut into runs piece by piece. An empty
table gives no rows. Strings of runs are compared by 64-bit hashes of
k-gram and bytes, the merged ones by their bytes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_CODE, CHUNK_BYTES, U64, lean_batches, mix, powers, stored, text_chunks
from .winnow import GRAM, PLACE_BITS, SPAN, WIDE, runs

#: Bytes of a bucket of runs, of a bin of run texts (about), and rows and items of a broadcast table at most.
BUCKET_BYTES, BIN_BYTES = 12 << 20, 1 << 20
BROADCAST_ROWS, BROADCAST_ITEMS = 400_000, 4_000_000
FLUSH_RUNS = 400_000
#: From this many different runs of a k-gram among ``FLUSH_RUNS``, they are dealt by their bytes.
LOCAL_HOT = 8
#: A k-gram with more different runs than this is dealt by the cores of its strings too.
HOT_RUNS = 20_000
#: Bytes that UTF-8 never holds: between runs, and at the end of a shard.
BREAK, STOP = 0xFF, 0xFE
FIELDS = (("gram", "<u8"), ("bytes", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("strings", "<u2"))


def pack(cols: dict[str, np.ndarray], rows: np.ndarray) -> bytes:
    """Rows column by column: what is alike stands together and compresses well."""
    return b"".join(cols[k][rows].astype(t).tobytes() for k, t in FIELDS)


def unpack(cells: list[bytes]) -> dict[str, np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in FIELDS)
    parts: dict[str, list[np.ndarray]] = {k: [] for k, _ in FIELDS}
    for cell in cells:
        n, at = len(cell) // width, 0
        for k, t in FIELDS:
            parts[k].append(np.frombuffer(cell, dtype=t, count=n, offset=at))
            at += n * np.dtype(t).itemsize
    return {k: np.concatenate(v) if v else np.empty(0, dict(FIELDS)[k]) for k, v in parts.items()}


def order_runs(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by k-gram, bytes and place; where a k-gram starts, and where bytes start in that order."""
    order = np.lexsort((c["at"], c["doc"], c["bytes"], c["gram"]))
    g, b = c["gram"][order], c["bytes"][order]
    gram = np.append(True, g[1:] != g[:-1])[: len(g)]
    return order, gram, gram | np.append(True, b[1:] != b[:-1])[: len(g)]


def of_first(c: dict[str, np.ndarray], order: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Which runs, in that order, are the first run with their bytes: itself, or the same place of a row that repeats it."""
    head = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    return (c["doc"][order] == c["doc"][head]) & (c["at"][order] == c["at"][head])


def posted(docs: DataFrame, buckets: int) -> DataFrame:
    """Runs packed by bucket; ``copies`` are those whose bytes an earlier run of the same task has.

    Buckets from ``buckets`` on hold runs of frequent k-grams, dealt by k-gram and bytes; ``marks`` tells a k-gram's own bucket of it.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            c = {k: np.concatenate([h[k] for h in held]) for k, _ in FIELDS}
            order, head, fresh = order_runs(c)
            run = np.cumsum(head) - 1
            often = np.bincount(run[fresh], minlength=run[-1] + 1)[run] >= LOCAL_HOT
            gram, n = c["gram"], U64(buckets)
            by_bytes = mix(gram ^ mix(c["bytes"])) % n + n
            cells: list[list] = [[], [], [], []]

            def put(column: int, rows: np.ndarray, bucket: np.ndarray, packed) -> None:
                rows = np.sort(rows)
                b = bucket[rows].astype(np.int32)
                rows, b = rows[o := np.argsort(b, kind="stable")], b[o]
                edge = np.flatnonzero(np.append(True, b[1:] != b[:-1])[: len(b)])
                for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(rows)][: len(edge)], strict=True):
                    for i in range(1, 4):
                        cells[i].append(packed(rows[lo:hi]) if i == column else None)
                    cells[0].append(b[lo])

            whole = lambda rows: pack(c, rows)
            put(1, order[fresh & ~often], gram % n, whole)
            put(1, order[fresh & often], by_bytes, whole)
            put(2, order[~of_first(c, order, fresh)], c["doc"].view(U64) % n, whole)
            put(3, order[head & often], gram % n, lambda rows: gram[rows].astype("<u8").tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array(cells[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cells[1:])], ["bucket", "cells", "copies", "marks"]
            )

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, data, offs in text_chunks(batch.column(1)):
                # a long text goes by pieces of string starts; a run that is cut is two runs, which the transforms compare
                step = CHUNK_BYTES if len(data) > 2 * CHUNK_BYTES and hi - lo == 1 else max(len(data), 1)
                for at in range(0, max(len(data), 1), step):
                    part = data[at : at + step + SPAN - 1]
                    c = runs(part, offs if hi - lo > 1 else np.array([0, len(part)]))
                    c["at"] += at
                    c["doc"] = ids[lo:hi][c.pop("row")]
                    held.append(c)
                    size += len(c["at"])
                    if size >= FLUSH_RUNS:
                        yield flush()
                        held.clear()
                        size = 0
        if size:
            yield flush()

    return docs.select("doc", "text").mapInArrow(own, "bucket int, cells binary, copies binary, marks binary")


def settle(group: pa.Table, buckets: int) -> pa.Table:
    """Copies of a run (``gram`` null: their bytes go), the first runs of k-grams that have several, and those to meet by ``bytes``."""
    c = unpack([x for x in group.column("cells").to_pylist() if x is not None])
    copies = unpack([x for x in group.column("copies").to_pylist() if x is not None])
    marks = np.frombuffer(b"".join(x for x in group.column("marks").to_pylist() if x is not None), dtype="<u8")
    order, gram, fresh = order_runs(c)
    run = np.cumsum(gram) - 1
    several = np.bincount(run[fresh], minlength=run[-1] + 1 if len(run) else 0)[run] > 1 if len(run) else fresh
    apart = np.isin(c["gram"][order], marks) | (group.column("bucket")[0].as_py() >= buckets)
    first = np.flatnonzero(fresh & (several | apart))
    # a row that repeats is no copy of itself
    same = np.zeros(len(order), dtype=bool)
    same[1:] = ~fresh[1:] & (c["doc"][order][1:] == c["doc"][order][:-1]) & (c["at"][order][1:] == c["at"][order][:-1])
    old = order[~of_first(c, order, fresh) & ~same]
    want = order[first]
    cols = {k: np.concatenate((c[k][want], c[k][old], copies[k])) for k in ("doc", "at", "strings")}
    pad = np.zeros(len(old) + len(copies["doc"]), np.int64)
    asked = np.arange(len(cols["doc"])) < len(want)
    meet = np.concatenate((apart[first], pad.astype(bool)))
    return pa.table(
        {
            "doc": cols["doc"].astype(np.int64),
            "at": cols["at"].astype(np.int64),
            "strings": cols["strings"].astype(np.int32),
            "gram": pa.array(np.concatenate((c["gram"][want].view(np.int64), pad)), mask=~asked),
            "bytes": pa.array(np.concatenate((c["bytes"][want].view(np.int64), pad)), mask=~meet),
        }
    )


def met(found: DataFrame) -> DataFrame:
    """``found`` once runs of frequent k-grams have met by bytes: of two places of the same bytes the later is a copy.

    There are two at most: one from the bucket of their bytes, one from the k-gram's own.
    """
    place = F.struct("doc", "at", "strings")
    pairs = found.where("bytes IS NOT NULL").groupBy("gram", "bytes").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    copy = F.when(F.struct("low.doc", "low.at") != F.struct("high.doc", "high.at"), F.struct("high.*", F.lit(None).cast("long").alias("gram")))
    told = pairs.select(F.inline(F.array_compact(F.array(F.struct("low.*", "gram"), copy))))
    return found.where("bytes IS NULL").drop("bytes").unionByName(told)


def core_hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run and each quarter of the k-gram's places in a string: a hash of the bytes all those strings cover.

    Quarters that a run's strings don't reach get a value of their own. Also returns where each run's k-gram starts.
    """
    n = len(data)
    up, down = powers(n + 1)
    run = np.zeros(n + 1, dtype=U64)
    np.cumsum(BYTE_CODE[data] * up[:n], out=run[1:])
    gram = mix((run[GRAM:] - run[:-GRAM]) * down[: n - GRAM + 1])
    # the k-gram is the least of the first string's
    span = gram[np.minimum(first[:, None] + np.arange(WIDE), len(gram) - 1)]
    mark = first + np.argmin(span >> U64(PLACE_BITS), axis=1)
    out = np.empty((len(first), 4), dtype=U64)
    edge = [WIDE * i // 4 for i in range(5)]
    for i in range(4):
        lo, hi = mark - edge[i], mark - (edge[i + 1] - 1) + SPAN
        ok = (hi <= first + size) & (lo >= first)
        a, b = np.maximum(lo, 0), np.minimum(hi, n)
        out[:, i] = np.where(ok, mix((run[b] - run[a]) * down[a]), mix(np.arange(len(first), dtype=U64) + U64(i << 40)))
    return out, mark


def quarters(body: bytes) -> list[tuple[int, int, int]]:
    """A run's pieces by the quarter in which its k-gram stands in the strings: (first string, strings, hash of their core).

    Equal strings have the k-gram at the same distance, so they lie in pieces of the same quarter and the same core.
    """
    data = np.frombuffer(body, dtype=np.uint8)
    cores, mark = core_hashes(data, np.array([0]), np.array([len(body)]))
    strings, place = len(body) - SPAN + 1, int(mark[0])
    edge = [WIDE * i // 4 for i in range(5)]
    out = []
    for i in range(4):
        low, high = max(0, place - edge[i + 1] + 1), min(strings - 1, place - edge[i])
        if low <= high:
            out.append((low, high - low + 1, int(cores[0, i].view(np.int64)) ^ i))
    return out


def shard_transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of a shard that ends in its only STOP, and their two preceding bytes as one symbol."""
    n = len(text)
    twice = np.concatenate((text, text[:8])).astype(U64)
    key = np.zeros(n, dtype=U64)
    for i in range(8):
        key = (key << U64(8)) | twice[i : n + i]
    order = np.argsort(key)
    k = key[order]
    head = np.append(True, k[1:] != k[:-1])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    reach = 8
    while True:
        # only groups that are still tied are told apart, by the rank of what follows
        tied = np.flatnonzero(~head | ~np.append(head[1:], True))
        if not len(tied):
            break
        rows = order[tied]
        after = rows + reach
        pair = rank[rows] * n + rank[np.where(after >= n, after - n, after)]
        o = np.argsort(pair, kind="stable")
        order[tied] = rows[o]
        p = pair[o]
        fresh = np.append(True, p[1:] != p[:-1])
        head[tied] = fresh
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        reach *= 2
    return order, (text[order - 2].astype(np.uint16) << 8) | text[order - 1]


def merge(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges two transforms: which source each merged suffix is of, and where blocks equal in ``SPAN`` symbols start.

    The interleave starts as all of one, then all of two. A round writes the sources' symbols into it and
    sorts it stably by them: it is then right to two symbols more.
    """
    n = len(one) + len(two)
    source = np.zeros(n, dtype=bool)
    source[len(one) :] = True
    block = np.zeros(n, dtype=np.int32)
    symbols = np.empty(n, dtype=np.uint16)
    for _ in range(SPAN // 2):
        symbols[~source], symbols[source] = one, two
        order = np.argsort(symbols, kind="stable")
        source, block, now = source[order], block[order], symbols[order]
        fresh = (now[1:] != now[:-1]) | (block[1:] != block[:-1])
        block[0] = 0
        np.cumsum(fresh, out=block[1:])
    return source, np.append(True, fresh) if n > 1 else np.ones(n, dtype=bool)


def repeats(group: pa.Table) -> pa.Table:
    """Byte spans that repeat earlier ones among the first runs of a bin's k-grams: ``doc, start, end``."""
    grams = group.column("gram").to_numpy()
    doc, at = group.column("doc").to_numpy(), group.column("at").to_numpy()
    body = group.column("body").combine_chunks()
    data = np.frombuffer(b"".join(body.to_pylist()), dtype=np.uint8)
    size = np.array([len(x.as_py()) for x in body], dtype=np.int64)
    first = np.cumsum(size) - size
    cores, _ = core_hashes(data, first, size)
    live = np.zeros(len(size), dtype=bool)
    for i in range(4):
        o = np.lexsort((cores[:, i], grams))
        same = (grams[o][1:] == grams[o][:-1]) & (cores[o, i][1:] == cores[o, i][:-1])
        live[o[1:][same]] = live[o[:-1][same]] = True
    chosen = np.flatnonzero(live)
    none = pa.table({"doc": pa.array([], pa.int64()), "start": pa.array([], pa.int64()), "end": pa.array([], pa.int64())})
    if not len(chosen):
        return none
    shards = []
    for part in (chosen[0::2], chosen[1::2]):
        pieces, owner, offset = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for r in part.tolist():
            pieces += [data[first[r] : first[r] + size[r]], np.array([BREAK], np.uint8)]
            owner.append(np.full(size[r] + 1, r))
            offset.append(np.arange(size[r] + 1))
        text = np.concatenate([*pieces, np.array([STOP], np.uint8)])
        order, symbols = shard_transform(text)
        shards.append((order, symbols, np.append(np.concatenate(owner), -1), np.append(np.concatenate(offset), 0)))
    source, fresh = merge(shards[0][1], shards[1][1])
    n = len(source)
    row, off = np.empty(n, np.int64), np.empty(n, np.int64)
    for which, (order, _, owner, offset) in ((~source, shards[0]), (source, shards[1])):
        row[which], off[which] = owner[order], offset[order]
    block = np.cumsum(fresh)
    whole = (row >= 0) & (off + SPAN <= size[row])  # a string that ends within its run
    row, off, block = row[whole], off[whole], block[whole]
    d, s = doc[row], at[row] + off
    o = np.lexsort((s, d, block))
    b, d, s = block[o], d[o], s[o]
    head = np.append(True, b[1:] != b[:-1])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(o)), 0))
    late = (d != d[lead]) | (s != s[lead])
    d, s = d[late], s[late]
    o = np.lexsort((s, d))
    d, s = d[o], s[o]
    if not len(d):
        return none
    cut = np.append(True, (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1))
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(d)) - 1
    return pa.table({"doc": d[starts], "start": s[starts], "end": s[ends] + SPAN})


def fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted runs: ``gram, doc, at, body`` and the ``key`` that they are dealt by."""
    hot = stored(wanted.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_RUNS).select("gram", F.lit(True).alias("hot")), "hot")
    # there is one such k-gram for HOT_RUNS runs at most
    few = hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    wanted = wanted.join(F.broadcast(hot) if few else hot, "gram", "left")
    listed = wanted.groupBy("doc").agg(F.collect_list(F.struct("at", "strings", "gram", "hot")).alias("runs"))
    rows = with_documents(docs, listed, F.size("runs"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            size = 0
            for key, text, own_runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                for r in own_runs:
                    piece = raw[r["at"] : r["at"] + r["strings"] + SPAN - 1]
                    if len(piece) < r["strings"] + SPAN - 1:
                        continue  # of another row with this doc_id
                    for low, n, core in quarters(piece) if r["hot"] else ((0, r["strings"], 0),):
                        part = piece[low : low + n + SPAN - 1]
                        for col, v in zip(out, (r["gram"], key, r["at"] + low, part, core), strict=True):
                            col.append(v)
                        size += len(part)
                if size > 8 << 20:
                    yield _segments(out)
                    out, size = [[], [], [], [], []], 0
            if out[0]:
                yield _segments(out)

    return rows.select("doc", "text", "runs").mapInArrow(own, "gram long, doc long, at long, body binary, key long")


def _segments(cols: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["gram", "doc", "at", "body", "key"])


def keyed(docs: DataFrame) -> DataFrame:
    """``doc, doc_id, text``: documents numbered in order; the doc_id itself where all are there and differ."""
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    if shared.isEmpty():
        return docs.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    # the number of a row without a name must stay the same from here on
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0))
    rows = stored(docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), own.alias("own")), "rows")
    names = rows.select("doc_id", "hash", "own").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "hash", "own")
    names = stored(names.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").alias("name"), "hash", "own"), "names")
    found = rows.join(names, ["hash", "own"]).where(F.col("doc_id").eqNullSafe(F.col("name")))
    return stored(found.select("doc", "doc_id", "text"), "keyed")


def with_documents(docs: DataFrame, listed: DataFrame, items, how: str = "inner") -> DataFrame:
    """Joins a table by document to the texts; it is broadcast if its counted rows and items are few, else both are shuffled."""
    listed = stored(listed, "listed")
    some = listed.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(items), F.lit(0)).alias("items")).first()
    small = some["rows"] <= BROADCAST_ROWS and some["items"] <= BROADCAST_ITEMS
    return docs.join(F.broadcast(listed) if small else listed.hint("shuffle_hash"), "doc", how)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc, start, end``: byte spans of ``docs`` (doc, text) that repeat earlier ones; they may overlap."""
    lean_batches(docs.sparkSession)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(32, int(total * 2 / WIDE * 30 / BUCKET_BYTES) + 1)
    own = lambda group: settle(group, buckets)
    found = met(stored(posted(docs, buckets).groupBy("bucket").applyInArrow(own, "doc long, at long, strings int, gram long, bytes long"), "runs"))
    copies = found.where("gram IS NULL").select("doc", F.col("at").alias("start"), (F.col("at") + F.col("strings") + SPAN - 1).alias("end"))
    wanted = found.where("gram IS NOT NULL")
    size = wanted.agg(F.coalesce(F.sum(F.col("strings") + SPAN), F.lit(0)).alias("n")).first()["n"]
    bins = int(size / BIN_BYTES) + 1
    dealt = fetch(docs, wanted).withColumn("bin", F.pmod(F.xxhash64("gram", "key"), F.lit(bins)))
    return copies.unionByName(dealt.groupBy("bin").applyInArrow(repeats, "doc long, start long, end long"))


def merged(found: DataFrame) -> DataFrame:
    """``doc, spans``: the spans of each document in order, those that meet or overlap as one."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(i).to_numpy() for i in range(3)] for batch in batches]
        if not parts:
            return
        doc, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        o = np.lexsort((start, doc))
        doc, start, end = doc[o], start[o], end[o]
        fresh = np.append(True, doc[1:] != doc[:-1])
        base = np.cumsum(fresh) << 40  # texts are shorter than that
        reach = np.maximum.accumulate(end + base)
        cut = np.flatnonzero(np.append(True, (start + base)[1:] > reach[:-1]))
        last = np.append(cut[1:], len(doc)) - 1
        doc, start, end = doc[cut], start[cut], (reach - base)[last]
        edge = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        cells = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(doc)).astype(np.int32)), cells)
        yield pa.RecordBatch.from_arrays([pa.array(doc[edge]), lists], ["doc", "spans"])

    return found.repartition("doc").mapInArrow(own, "doc long, spans array<struct<start:bigint,end:bigint>>")


def cut(docs: DataFrame) -> DataFrame:
    """``doc_id, text, spans array<struct<start,end>>`` for every row: the spans that go, in order and apart."""
    docs = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    listed = merged(repeated_spans(docs))
    return with_documents(docs, listed, F.size("spans"), "left").select("doc_id", "text", "spans")


def digest(rows: DataFrame) -> DataFrame:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                own = [(x["start"], x["end"]) for x in spans or () if x["end"] <= len(raw)]
                sha, last = hashlib.sha256(), 0
                for a, b in own:
                    sha.update(raw[last:a])
                    last = b
                sha.update(raw[last:])
                out.append((len(raw), sum(b - a for a, b in own), len(own), sha.hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows.mapInArrow(hashed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(cut(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
