"""Words of Arrow string columns as numpy arrays: where they stand, and 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+``. Texts are read straight from Arrow's buffers, a
piece of about a megabyte at a time, so the working arrays stay small however
long a text is; pieces are cut only at white space or between texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_rng = np.random.Generator(np.random.PCG64(20240917))
_MIX = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def as_is() -> np.ndarray:
    return _MIX


def lowered() -> np.ndarray:
    """The byte table with A-Z equal to a-z."""
    t = _MIX.copy()
    t[65:91] = t[97:123]
    return t


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, PIECE + 1)
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def scrambled(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column (null: empty) and the n + 1 offsets of its rows."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def parts(column: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a column with about ``size`` bytes of text each (one row at least)."""
    if len(column):
        offsets, lo = flat(column)[1], 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
            yield lo, min(hi, len(column))
            lo = min(hi, len(column))
        released()


def released() -> None:
    """Give the system back what Arrow and the C library hold free: workers live on, and so would the peak of every stage."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


@dataclass
class Words:
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after it
    hash: np.ndarray  # 64-bit hash of its bytes
    first: np.ndarray  # n + 1: number of the first word of each text

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """The words of all texts, with hashes by the byte table (:func:`as_is` or :func:`lowered`)."""
    starts, ends, hashes = [], [], []
    lo, stop = int(offsets[0]), int(offsets[-1])
    while lo < stop:
        hi = min(lo + PIECE, stop)
        while hi < stop:
            gaps = np.flatnonzero(SPACE[data[lo:hi]])
            between = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
            cut = max(lo + int(gaps[-1]) + 1 if len(gaps) else lo, between)
            if cut > lo:
                hi = cut
                break
            hi = min(hi + PIECE, stop)
        piece = data[lo:hi]
        solid = ~SPACE[piece]
        border = offsets[np.searchsorted(offsets, lo, "left"):np.searchsorted(offsets, hi, "left")] - lo
        opens = solid.copy()
        opens[1:] &= ~solid[:-1]
        opens[border] = solid[border]
        closes = solid.copy()
        closes[:-1] &= ~solid[1:]
        inner = border[border > 0] - 1
        closes[inner] = solid[inner]
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        power, inverse = _powers(len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(table[piece] * power[:len(piece)], out=sums[1:])
        hashes.append(scrambled((sums[e] - sums[s]) * inverse[s]))
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    none = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else none
    return Words(start, np.concatenate(ends) if ends else none, np.concatenate(hashes) if hashes else none.astype(np.uint64),
                 np.searchsorted(start, offsets))


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words starting at each word, and which of them lie within one text."""
    w = len(words.hash)
    if w < n:
        return np.zeros(w, np.uint64), np.zeros(w, bool)
    total = np.zeros(w, np.uint64)
    for j in range(n):
        total[:w - n + 1] += words.hash[j:w - n + 1 + j] * _MIX[j]
    inside = np.zeros(w, bool)
    inside[:w - n + 1] = words.row[:w - n + 1] == words.row[n - 1:]
    return scrambled(total), inside


def sums(values: np.ndarray, first: np.ndarray, dtype=np.int64) -> np.ndarray:
    """The sums of ``values`` over the stretches between ``first``'s n + 1 borders (which start at ``first[0]``)."""
    out = np.zeros(len(first) - 1, dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, first[full], dtype=dtype) if full[-1] == len(first) - 2 and first[-1] == len(values) \
            else np.add.reduceat(values[:first[-1]], first[full], dtype=dtype)
    return out
