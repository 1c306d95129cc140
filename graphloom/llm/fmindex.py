"""Benchmark decontamination through an FM-index of every training shard.

A shard is a slice of a few megabytes of texts. Its words are reduced to the benchmark's alphabet: a word
that no benchmark item holds can be part of no match and becomes a separator, as does every text's end. The
Burrows-Wheeler transform of the shard's suffixes goes into a wavelet matrix, and all test phrases are searched
backwards at once with its ranks. Occurrences are located from sampled suffix positions and merged into removal spans.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A phrase is each run of
``WINDOW`` words of an item, or the whole item if it has fewer but some. Null and empty texts have no words.
Words are compared by 64-bit hashes. The benchmark is broadcast: its bytes are checked against ``BENCHMARK_LIMIT`` first, and
a larger one is worked through in slices of its items, a pass over the documents each. A text longer than a chunk is searched in several
shards. Items that share an id are one item, items without one have the empty id; an empty benchmark hits nothing, an empty table gives no
rows. Rows need no key; rows that repeat are each answered. Extra columns pass through; those of the names in ``MADE`` give way in
:func:`annotate` and are kept by :func:`decontaminate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, lean_batches, lowered, put_back, set_aside, stored, text_chunks, words

WINDOW = 10
#: Every so many suffix positions one is kept, for locating.
SAMPLE = 8
#: Words of a shard at most: texts of a chunk are one shard, a longer text is several.
SHARD_WORDS = 1 << 19
#: Bytes of benchmark text that are broadcast at most; of a larger benchmark so many are searched in one pass, about.
BENCHMARK_LIMIT = 64 << 20

FOLD = lowered()
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


#: Columns that :func:`annotate` makes; input columns of these names give way.
MADE = ("n_words", "n_hit", "items", "spans")


class WaveletMatrix:
    """Rank of a symbol in any prefix, by one bit vector a level."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.ones, self.zeros = bits, [], []
        now = symbols
        for level in range(bits - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            count = np.zeros(len(now) + 1, dtype=np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(now) - int(count[-1]))
            now = np.concatenate((now[~bit], now[bit]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands before position ``upto``."""
        lo, hi = np.zeros_like(upto), upto
        for depth, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (self.bits - 1 - depth)) & 1).astype(bool)
            lo = np.where(bit, zeros + ones[lo], lo - ones[lo])
            hi = np.where(bit, zeros + ones[hi], hi - ones[hi])
        return hi - lo


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffixes in order, by rank doubling; the last symbol must be the least and occur once."""
    n = len(symbols)
    rank, reach = symbols.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        rank_sorted = rank[order]
        new = np.cumsum(np.concatenate(([0], rank_sorted[1:] != rank_sorted[:-1])))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        rank = rank * n + np.roll(rank, -reach)
        order = np.argsort(rank, kind="stable")
        reach *= 2


class FMIndex:
    """Over symbols below ``alphabet``; the last is 0 and the only 0."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.n = len(symbols)
        order = suffix_order(symbols)
        self.bwt = symbols[order - 1]  # position 0 wraps to the end
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=alphabet))))
        self.tree = WaveletMatrix(self.bwt, int(alphabet).bit_length())
        self.kept = order % SAMPLE == 0
        self.sample_at = np.cumsum(self.kept) - 1
        self.sample = order[self.kept]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows, left-aligned) at once: half-open ranges of suffixes."""
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), self.n, dtype=np.int64)
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((sizes > step) & (hi > lo))
            if not len(live):
                break
            symbol = phrases[live, sizes[live] - 1 - step]
            lo[live] = self.starts[symbol] + self.tree.rank(symbol, lo[live])
            hi[live] = self.starts[symbol] + self.tree.rank(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back through the transform until a sampled position."""
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        while len(live := np.flatnonzero(~self.kept[at])):
            symbol = self.bwt[at[live]]
            at[live] = self.starts[symbol] + self.tree.rank(symbol, at[live])
            steps[live] += 1
        return (self.sample[self.sample_at[at]] + steps) % self.n


class Benchmark:
    """The test phrases over the benchmark's own alphabet: 0 ends a shard, 1 separates, words follow from 2."""

    def __init__(self, items: list[tuple[str, str | None]]) -> None:
        texts = pa.array([t for _, t in items], type=pa.string())
        hashes: list[np.ndarray] = []
        for lo, hi, data, offs in text_chunks(texts):
            starts, _, found = words(data, offs, IS_WORD, FOLD)
            edge = np.searchsorted(starts, offs)
            hashes += [found[edge[i] : edge[i + 1]] for i in range(hi - lo)]
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, U64)
        phrases: dict[tuple[int, ...], set[str]] = {}
        for (item, _), own in zip(items, hashes, strict=True):
            ids = (np.searchsorted(self.vocabulary, own) + 2).tolist()
            for i in range(max(1, len(ids) - WINDOW + 1)) if ids else ():
                phrases.setdefault(tuple(ids[i : i + WINDOW]), set()).add(item)
        self.items = list(phrases.values())
        self.sizes = np.array([len(p) for p in phrases], dtype=np.int64)
        self.phrases = np.zeros((len(phrases), WINDOW), dtype=np.int64)
        for i, p in enumerate(phrases):
            self.phrases[i, : len(p)] = p
        # a small table of hash prefixes sends most foreign words away at once
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.vocabulary >> U64(44)] = True

    def ids(self, words: np.ndarray) -> np.ndarray:
        out = np.ones(len(words), dtype=np.int64)
        some = np.flatnonzero(self.maybe[words >> U64(44)])
        if len(some):
            at = np.searchsorted(self.vocabulary, words[some])
            at[at == len(self.vocabulary)] = 0
            out[some] = np.where(self.vocabulary[at] == words[some], at + 2, 1)
        return out


def shard_hits(bench: Benchmark, ids: np.ndarray, word_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of every occurrence in a shard of words with their symbols and texts."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(bench.sizes) or not len(ids):
        return none
    # runs of symbols, each closed by a separator; runs too short for the shortest phrase go
    inside = ids > 1
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (word_doc[1:] != word_doc[:-1]) | ~inside[:-1]
    run = np.cumsum(fresh & inside)
    length = np.bincount(run[inside], minlength=run[-1] + 1)
    where = np.flatnonzero(inside & (length[run] >= bench.sizes.min()))
    if not len(where):
        return none
    breaks = np.flatnonzero(np.diff(run[where])) + 1
    symbols = np.append(np.insert(ids[where], breaks, 1), (1, 0))
    origin = np.append(np.insert(where, breaks, -1), (-1, -1))
    index = FMIndex(symbols, len(bench.vocabulary) + 2)
    lo, hi = index.search(bench.phrases, bench.sizes)
    many = hi - lo
    phrase = np.repeat(np.arange(len(many)), many)
    rows = np.arange(len(phrase)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    return phrase, origin[index.locate(rows)]


def chunk_hits(bench: Benchmark, ids: np.ndarray, word_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`shard_hits` of a chunk, by shards of ``SHARD_WORDS`` words; a shard reads on as far as a phrase that starts in it can reach."""
    out = []
    for a in range(0, max(len(ids), 1), SHARD_WORDS):
        b = a + SHARD_WORDS
        phrase, first = shard_hits(bench, ids[a : b + WINDOW - 1], word_doc[a : b + WINDOW - 1])
        own = first < SHARD_WORDS
        out.append((phrase[own], first[own] + a))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def annotate(docs: DataFrame, bench: Benchmark, text: str = "text", more: bool = False) -> DataFrame:
    """Adds ``n_words, n_hit, items array<string>, spans array<struct<start,end>>`` (UTF-8 byte spans to remove).

    With ``more`` the columns are there already, from other items, and what is found is added.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    docs = docs if more else docs.drop(*MADE)
    own_columns = [c for c in docs.columns if c not in MADE]
    shared = spark.sparkContext.broadcast(bench)
    schema = docs.select(*[F.col(f"`{c}`") for c in own_columns]).schema.simpleString()[7:-1]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for lo, hi, data, offs in text_chunks(batch.column(at)):
                starts, ends, hashes = words(data, offs, IS_WORD, FOLD)
                word_doc = np.searchsorted(offs, starts, side="right") - 1
                phrase, first = chunk_hits(b, b.ids(hashes), word_doc)
                edge = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + b.sizes[phrase], -1)
                hit = np.cumsum(edge[:-1]) > 0
                n = hi - lo
                known = [[] for _ in range(n)]
                if more:
                    known = batch.column(batch.schema.get_field_index("items")).slice(lo, n).to_pylist()
                    for d, cuts in enumerate(batch.column(batch.schema.get_field_index("spans")).slice(lo, n).to_pylist()):
                        for c in cuts:
                            hit[np.searchsorted(starts, offs[d] + c["start"]) : np.searchsorted(starts, offs[d] + c["end"])] = True
                n_hit = np.bincount(word_doc[hit], minlength=n)
                items: list[list[str]] = [list(x) for x in known]
                by_doc = word_doc[first]
                for p, d in np.unique(np.stack([phrase, by_doc], 1), axis=0).tolist():
                    items[d] += b.items[p]
                spans: list[list[dict]] = [[] for _ in range(n)]
                last = -2
                for w in np.flatnonzero(hit).tolist():
                    d = word_doc[w]
                    if w == last + 1 and spans[d]:
                        spans[d][-1]["end"] = int(ends[w] - offs[d])
                    else:
                        spans[d].append({"start": int(starts[w] - offs[d]), "end": int(ends[w] - offs[d])})
                    last = w
                part = batch.slice(lo, n).select(own_columns)
                extra = [
                    pa.array(np.bincount(word_doc, minlength=n).astype(np.int64)),
                    pa.array(n_hit.astype(np.int64)),
                    pa.array([sorted(set(x)) for x in items], type=pa.list_(pa.string())),
                    pa.array(spans, type=pa.list_(span)),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*part.schema.names, "n_words", "n_hit", "items", "spans"])

    return docs.mapInArrow(
        shards, f"{schema}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"
    )


def slices(benchmark: DataFrame) -> Iterator[Benchmark]:
    """The benchmark in slices of its items, each within ``BENCHMARK_LIMIT`` bytes of text, about; one is held at a time."""
    own = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    own = own.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    size = own.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    n = 2 * (size // BENCHMARK_LIMIT) + 1
    for i in range(n):
        part = own.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        # an iterator fetches one partition at a time
        yield Benchmark([(r["item"], r["text"]) for r in part.select("item", "text").toLocalIterator()])


def read_benchmark(benchmark: DataFrame) -> Benchmark:
    """A benchmark that fits one slice; larger ones go through :func:`marked`."""
    found = list(slices(benchmark))
    if len(found) > 1:
        raise ValueError(f"the benchmark has more than {BENCHMARK_LIMIT} bytes of text: use marked() or decontaminate()")
    return found[0]


def marked(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """:func:`annotate` by every slice of the benchmark: a pass adds its hits and items to those of the passes before, then is stored."""
    out = None
    for bench in slices(benchmark):
        if out is not None:
            out = stored(out, "slice")
        out = annotate(docs if out is None else out, bench, text, more=out is not None)
    return out


def remove_spans(texts: pa.Array, spans: list[list[dict]]) -> pa.Array:
    """Cuts byte spans (on character boundaries) out of each text."""
    out = []
    for text, cuts in zip(texts.to_pylist(), spans, strict=True):
        if text is None or not cuts:
            out.append(text)
            continue
        raw, at, kept = text.encode(), 0, []
        for c in cuts:
            kept.append(raw[at : c["start"]])
            at = c["end"]
        out.append(b"".join([*kept, raw[at:]]).decode())
    return pa.array(out, type=pa.string())


def cut_spans(rows: DataFrame) -> DataFrame:
    """Takes the ``spans`` out of ``text``."""
    names = rows.columns
    text, spans = names.index("text"), names.index("spans")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column(spans).to_pylist()
            if any(cuts):
                batch = batch.set_column(text, batch.schema.field(text), remove_spans(batch.column(text), cuts))
            yield batch

    return rows.mapInArrow(own, rows.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the removal spans cut out of ``text`` and ``n_chars`` counted anew; no row is dropped."""
    out = cut_spans(marked(set_aside(docs, MADE), benchmark))
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_hit") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", chars)
    return put_back(out, docs.columns, MADE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return marked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
SQL = rf"""
WITH lower_docs AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT row, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lower_docs),
bw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bp AS (SELECT item, least(len(ws), {WINDOW}) AS size, unnest(list_transform(range(1, greatest(len(ws) - {WINDOW} + 1, 1) + 1), lambda i: array_to_string(ws[i:i + {WINDOW} - 1], ' '))) AS phrase FROM bw WHERE len(ws) > 0),
p AS (SELECT DISTINCT item, size, phrase FROM bp),
g AS (SELECT row, n, size, array_to_string(ws[n:n + size - 1], ' ') AS phrase FROM (
  SELECT row, ws, unnest(range(1, len(ws) + 1)) AS n FROM dw), (SELECT DISTINCT size FROM p) WHERE n + size - 1 <= len(ws)),
h AS (SELECT row, n, size, item FROM g JOIN p USING (size, phrase)),
c AS (SELECT row, count(DISTINCT w) AS n_hit FROM (SELECT row, unnest(range(n, n + size)) AS w FROM h) GROUP BY row),
s AS (SELECT row, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT row, item FROM h) GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, '{EMPTY_SHA256}') AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c USING (row) LEFT JOIN s USING (row)
"""
