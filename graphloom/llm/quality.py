"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees learns one lookup table a feature (binned at quantiles of the training rows)
and one a chosen pair of features. A text's score is the logistic of the sum of its bins' entries.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, the least by a hash of their doc_id: a bounded, stated sample.
Features come from the whole text alone; one longer than a chunk is counted in pieces. A null text counts as empty and gets a score like
any other; a null doc_id counts as the empty string in the hold-out rule. Rows that repeat are each scored, an empty table gives no rows.
Labels that tie on a doc_id teach the least. Labels other than 0 and 1, and null ones, teach nothing;
without any usable label every score is 0.5. Extra columns pass through :func:`score`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, U64, lean_batches, put_back, set_aside, text_chunks, words

#: Labelled rows that the model is fitted on at most.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
BINS, ROUNDS, RATE, PAIRS, PAIR_BINS, PAIR_ROUNDS = 32, 250, 0.06, 6, 8, 60
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "points", "bangs", "bars", "lines", "foreign",
    "distinct_words", "distinct_pairs", "distinct_lines", "capital_words", "decorated_words", "longest_word", "stray_bytes",
)

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
IN_LINE = np.ones(256, dtype=bool)
IN_LINE[10] = False


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


CLASSES = [
    _class(bytes(range(65, 91))),
    _class(bytes(range(48, 58))),
    _class(b"#$%&*@^~+=<>{}[]\\/_`"),
    _class(b".,;:?'\"()-"),
    _class(b"!"),
    _class(b"|"),
    _class(b"\n"),
    _class(bytes(range(128, 256))),
    _class(bytes([*range(9), *range(11, 32), 127])),
]
#: One code a byte; 0 is all else.
CODE = sum((i + 1) * c.astype(np.uint8) for i, c in enumerate(CLASSES)).astype(np.uint8)
DECORATION = _class(b"#$%&*@^~+=|!<>{}[]\\/_`")


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each text has."""
    keys = np.sort((doc.astype(U64) << U64(44)) | (hashes >> U64(20)))
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[first] >> U64(44)).astype(np.int64), minlength=n)


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of features a text."""
    n = len(offs) - 1
    size = np.diff(offs)
    # bytes of each class: one count over (text, class)
    count = np.zeros(n * 10, dtype=np.int64)
    for at in range(0, len(data), CHUNK_BYTES):
        doc = np.searchsorted(offs, np.arange(at, min(at + CHUNK_BYTES, len(data))), side="right") - 1
        count += np.bincount(doc * 10 + CODE[data[at : at + CHUNK_BYTES]], minlength=n * 10)
    count = count.reshape(n, 10)
    starts, ends, hashes = words(data, offs, IS_WORD, None)
    wdoc = np.searchsorted(offs, starts, side="right") - 1
    n_words = np.bincount(wdoc, minlength=n)
    two = hashes[:-1] * U64(3) + hashes[1:]
    same = wdoc[:-1] == wdoc[1:]
    lines, _, line_hashes = words(data, offs, IN_LINE, None)
    ldoc = np.searchsorted(offs, lines, side="right") - 1
    n_lines = np.bincount(ldoc, minlength=n)
    length = ends - starts
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, wdoc, length)
    b, w = np.maximum(size, 1), np.maximum(n_words, 1)
    return np.stack(
        [
            np.log2(1 + size), np.log2(1 + n_words), np.bincount(wdoc, length, n) / w,
            *(count[:, i] / b for i in (1, 2, 3, 4, 5, 6, 7, 8)),
            _distinct(wdoc, hashes, n) / w,
            _distinct(wdoc[:-1][same], two[same], n) / np.maximum(n_words - 1, 1) if len(hashes) else np.zeros(n),
            _distinct(ldoc, line_hashes, n) / np.maximum(n_lines, 1),
            np.bincount(wdoc[CODE[data[starts]] == 1], minlength=n) / w,
            np.bincount(wdoc[DECORATION[data[ends - 1]]], minlength=n) / w,
            np.log2(1 + longest), count[:, 9] / b,
        ], 1,
    )


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best split of a histogram."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl > 2) & (hr > 2), gl**2 / (hl + 1) + gr**2 / (hr + 1), -1.0)
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]) - g.sum() ** 2 / (h.sum() + 1), at + 1) if len(gain) and gain[at] >= 0 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """A shallow regression tree over a histogram, as a value a bin."""
    gain, at = _best_cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate((_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)))


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree over a pair's grid: one cut along an axis, then one in each half along the other; with its gain."""
    best, out = -1.0, np.zeros_like(g)
    base = g.sum() ** 2 / (h.sum() + 1)
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        for at in range(1, len(gg)):
            halves = [(gg[:at].sum(0), hh[:at].sum(0)), (gg[at:].sum(0), hh[at:].sum(0))]
            rows = [_tree(a, b, 1) for a, b in halves]
            gain = sum((2 * r * a - r * r * (b + 1)).sum() for r, (a, b) in zip(rows, halves, strict=True)) - base
            if gain > best:
                grid = np.vstack([np.tile(rows[0], (at, 1)), np.tile(rows[1], (len(gg) - at, 1))])
                best, out = float(gain), grid if axis == 0 else grid.T
    return best, out


class PairwiseGam:
    """Lookup tables of features and of pairs of features."""

    def __init__(self) -> None:
        self.base = 0.0
        self.edges: list[np.ndarray] = [np.empty(0)] * len(FEATURES)
        self.tables: list[np.ndarray] = [np.zeros(1)] * len(FEATURES)
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def coarse(self, bins: np.ndarray, j: int) -> np.ndarray:
        return bins[:, j] * PAIR_BINS // (len(self.edges[j]) + 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[bins[:, j]]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            out += grid[self.coarse(bins, i), self.coarse(bins, j)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairwiseGam:
        if not len(y):
            return self
        p = np.clip(y.mean(), 0.5 / (len(y) + 1), 1 - 0.5 / (len(y) + 1))
        self.base = float(np.log(p / (1 - p)))
        self.edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        bins = self.bins(x)
        f = np.full(len(y), self.base)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            s = 1 / (1 + np.exp(-f))
            return y - s, s * (1 - s)

        for _ in range(ROUNDS):
            for j, table in enumerate(self.tables):
                g, h = slopes()
                step = RATE * _tree(np.bincount(bins[:, j], g, len(table)), np.bincount(bins[:, j], h, len(table)), 2)
                table += step
                f += step[bins[:, j]]
        cells = {}
        g, h = slopes()
        d = x.shape[1]
        gains = []
        for i in range(d):
            for j in range(i + 1, d):
                cell = self.coarse(bins, i) * PAIR_BINS + self.coarse(bins, j)
                grids = [np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h)]
                gains.append((_tree2(*grids)[0], i, j))
                cells[i, j] = cell
        self.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
        self.grids = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for pair, grid in zip(self.pairs, self.grids, strict=True):
                g, h = slopes()
                cell = cells[pair]
                step = RATE * _tree2(*[np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h)])[1]
                grid += step
                f += step.ravel()[cell]
        return self


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> PairwiseGam:
    """Fits the model on labelled rows outside the hold-out."""
    lean_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    # at most TRAIN_ROWS pairs of numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "quality")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column(0)):
                x = features(data, offs).astype(np.float32)
                cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * 4), hi - lo, [None, pa.py_buffer(x.tobytes())])
                yield pa.RecordBatch.from_arrays([cells.cast(pa.binary()), batch.column(1).slice(lo, hi - lo).cast(pa.int32())], ["x", "y"])

    table = rows.mapInArrow(own, "x binary, y int").orderBy("x", "y").limit(TRAIN_ROWS).toArrow()
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), dtype=np.float32).reshape(-1, len(FEATURES)).astype(np.float64)
    return PairwiseGam().fit(x, table.column("y").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: PairwiseGam) -> DataFrame:
    """``docs`` with a ``score`` (0 to 1) for every row; an input column of that name gives way."""
    docs = docs.drop("score")
    lean_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column(at)):
                s = shared.value.score(features(data, offs).astype(np.float32).astype(np.float64))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], [*part.schema.names, "score"])

    return docs.mapInArrow(own, f"{docs.schema.simpleString()[7:-1]}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose text scores ``threshold`` or more."""
    scored = score(set_aside(docs, ("score",)), train(docs, labels)).where(F.col("score") >= threshold)
    return put_back(scored, docs.columns, ("score",))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
