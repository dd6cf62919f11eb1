"""Byte-level text helpers shared by the operators of this package.

Texts arrive as Arrow string columns; the helpers work on the UTF-8 buffer with
numpy, in slices of about ``SLICE`` bytes, so memory stays bounded whatever the
batch holds (a single longer text makes a slice of its own). Null texts count
as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once: eight bytes of a table for each, several tables at a time.
SLICE = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data, off


def slices(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def parts(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of each slice of the column."""
    data, off = utf8(column)
    for i, j in slices(off, limit):
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


@lru_cache(maxsize=1)
def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse mod 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, SLICE + 1)
        inv = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.concatenate([np.ones(1, _U), np.full(m, b, _U).cumprod(dtype=_U)]) for b in (_BASE, inv)]
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolling:
    """Hashes of any byte ranges of a buffer, equal for equal bytes."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_byte_values()[data] * self.up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _lower_table()[data]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space, and how many each row has."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = off[:-1][off[1:] > off[:-1]]
    first[full] = solid[full]
    ends = off[1:][off[1:] > off[:-1]] - 1
    last[ends] = solid[ends]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, off)
    return starts, np.flatnonzero(last) + 1, np.diff(bounds)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every lower-cased (A-Z) word, and the number of words per row.

    Hashes are taken over about ``SLICE`` bytes at a time, so a very long text
    needs no larger tables than others."""
    low = lower_ascii(data)
    s, e, counts = words(low, off)
    out = np.empty(len(s), _U)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + SLICE, "right")))
        a = s[i]
        out[i:j] = Rolling(low[a : e[j - 1]]).of(s[i:j] - a, e[i:j] - a)
        i = j
    return out, counts


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Per row: sorted distinct hashes of its n-word shingles. A row with fewer
    words is one shingle (the whole sequence); one without words is empty."""
    h, counts = word_hashes(data, off)
    at = 0
    for c in counts.tolist():
        w = h[at : at + c]
        at += c
        if c == 0:
            yield w
        elif c < n:
            x = np.full(1, c, _U)
            for v in w:
                x = mix(x * _U(_BASE) + v)
            yield x
        else:
            x = w[: c - n + 1].copy()
            for k in range(1, n):
                x *= _U(_BASE)
                x += w[k : c - n + 1 + k]
            yield np.unique(mix(x + _U(n)))
