"""Vectorised word, line and window hashing over Arrow text columns.

Texts are handled as the UTF-8 bytes of a whole batch; words are spans of that buffer, and a
span's identity is a 64-bit polynomial hash with random byte values and a final mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_STEP = np.uint64(0x9E3779B97F4A7C13)  # 3 modulo 4, so that 1 - step has a single factor 2
_VALUES = np.random.default_rng(20240131).integers(1, 2**64, 256, dtype=np.uint64)
_INVERSE = np.uint64(pow(int(_STEP), -1, 2**64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

#: ASCII white space: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, everything else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        tables = []
        for base in (_STEP, _INVERSE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers = tables[0], tables[1]
    return _powers


def blocks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo:hi`` of a string column with their bytes and offsets, about ``limit`` bytes at a time (one long text may exceed it)."""
    col = column.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    body = col.buffers()[2] if len(col) else None
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of ``inside``; no run crosses a row's border."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offs] = True
    first, last = inside.copy(), inside.copy()
    if len(inside):
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``k`` consecutive items of one row, and the index of each window's first item."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - k + 1
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = mix(out * _STEP + h[at + j])
    return out, at


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many of ``flags`` are set in each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
