"""Helpers shared by the training-data operators.

Texts are handled as raw UTF-8 bytes taken straight from Arrow buffers, in chunks of a few
megabytes, so that a worker's memory does not depend on the partition or the batch size.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import forget, shared_path, stored

__all__ = ["forget", "shared_path", "stored"]

#: Bytes of text that one vectorised step handles, about; a longer text is worked through in pieces.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1_000
U64 = np.uint64
MASK = (1 << 64) - 1
#: Odd base of the polynomial word hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def lean_batches(spark: SparkSession) -> None:
    """Texts reach Python in Arrow batches of ``BATCH_ROWS`` rows, unless the session has its own size: a worker then holds a few megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def trim() -> None:
    """Gives back what the worker's earlier steps have freed: Spark reuses workers, and the C library keeps freed memory otherwise."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (give := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        give(0)


def set_aside(docs: DataFrame, made: tuple[str, ...]) -> DataFrame:
    """Renames the columns that bear a name which an operator makes; :func:`put_back` restores them."""
    return docs.select(*[F.col(f"`{c}`").alias(f"__own_{c}") if c in made else F.col(f"`{c}`") for c in docs.columns])


def put_back(out: DataFrame, columns: list[str], made: tuple[str, ...]) -> DataFrame:
    return out.select(*[F.col(f"`__own_{c}`").alias(c) if c in made else F.col(f"`{c}`") for c in columns])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        for key, base in (("up", BASE), ("down", BASE_INV)):
            out = np.full(size, base, dtype=U64)
            out[0] = 1
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit moves every output bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(BASE)) | U64(1)


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, row offsets in those bytes); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    raw = texts.fill_null("").cast(pa.large_binary())
    if not len(raw):
        return
    _, offs, data = raw.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(raw):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def lowered() -> np.ndarray:
    """Byte table that lower-cases A-Z alone."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; no run crosses a row."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = is_word[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offs[:-1][np.diff(offs) > 0]
    before[full] = False
    after[full[1:] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def piece_edges(data: np.ndarray, is_word: np.ndarray) -> list[int]:
    """Where a chunk is cut into pieces of ``CHUNK_BYTES``, about: always before a byte that is no word's."""
    out, n = [0], len(data)
    while out[-1] + 2 * CHUNK_BYTES < n:
        at = out[-1] + CHUNK_BYTES
        while at < n:
            outside = np.flatnonzero(~is_word[data[at : at + CHUNK_BYTES]])
            if len(outside):
                at += int(outside[0])
                break
            at += CHUNK_BYTES
        if at >= n:
            break
        out.append(at)
    return [*out, n]


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of a chunk's words; what a piece needs on the way is let go with it."""
    edge = piece_edges(data, is_word)
    out = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        part = data[a:b]
        starts, ends = word_spans(part, np.clip(offs, a, b) - a, is_word)
        out.append((starts + a, ends + a, word_hashes(part, starts, is_word, fold)))
    if len(out) == 1:
        return out[0]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def word_hashes(data: np.ndarray, starts: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None) -> np.ndarray:
    """A 64-bit hash of each word's (case-folded) bytes."""
    if not len(starts):
        return np.empty(0, U64)
    codes = BYTE_CODE[fold] if fold is not None else BYTE_CODE.copy()
    codes = np.where(is_word, codes, U64(0))
    up, down = powers(len(data))
    terms = codes[data]
    terms *= up[: len(data)]
    return mix(np.add.reduceat(terms, starts) * down[starts])
