"""Content-defined runs: consecutive strings of ``SPAN`` bytes that choose the same place.

Every string chooses the least of its k-grams by hash, of equals the first. So equal strings choose equal k-grams
at equal distances, wherever they stand, and all occurrences of a string are found among the runs of one k-gram.
"""

from __future__ import annotations

import numpy as np

from .common import BYTE_CODE, U64, mix, powers

#: Bytes of a string, of a k-gram, and k-grams that a string holds.
SPAN, GRAM = 100, 32
WIDE = SPAN - GRAM + 1
#: Low bits of a hash that give way to the place, so that the least is also the first.
PLACE_BITS = 24


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by doubling."""
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def runs(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of the texts in a chunk: ``row``, ``at`` (first string's byte in the text), ``strings`` (how many), ``gram``
    (the chosen k-gram's hash) and ``bytes`` (hash of all bytes that the run's strings cover, and of their number)."""
    n = len(data)
    if n < SPAN:
        return {k: np.empty(0, t) for k, t in (("row", int), ("at", int), ("strings", int), ("gram", U64), ("bytes", U64))}
    up, down = powers(n + 1)
    run = np.zeros(n + 1, dtype=U64)
    np.cumsum(BYTE_CODE[data] * up[:n], out=run[1:])
    gram = mix((run[GRAM:] - run[:-GRAM]) * down[: n - GRAM + 1])
    bits = U64(max(PLACE_BITS, n.bit_length()))
    least = _least(((gram >> bits) << bits) | np.arange(len(gram), dtype=U64), WIDE)
    # a string must end within its text
    inside = np.ones(len(least), dtype=bool)
    for end in offs[1:-1].tolist():
        inside[max(0, end - SPAN + 1) : end] = False
    fresh = np.ones(len(least), dtype=bool)
    fresh[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(least)))
    first, count = first[inside[first]], count[inside[first]]
    row = np.searchsorted(offs, first, side="right") - 1
    covered = mix(mix((run[first + count + SPAN - 1] - run[first]) * down[first]) + count.astype(U64))
    place = (least[first] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    return {"row": row, "at": first - offs[row], "strings": count, "gram": gram[place], "bytes": covered}
