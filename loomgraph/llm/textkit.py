"""Vectorised text primitives over Arrow buffers: words, word hashes, slices of bounded size.

All functions work on the UTF-8 bytes of whole texts; a null text counts as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
#: Blanks between words: space and U+0009 to U+000D (fixed values).
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of them."""
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and offsets into them (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = 1 << 20):
    """Cut a column into runs of whole texts of about ``most`` bytes: (first row, last row, bytes, offsets)."""
    data, offsets = column_bytes(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def parts(data: np.ndarray, most: int, blank: np.ndarray = BLANK):
    """(start, end) of parts of about ``most`` bytes that cut one long text before blanks, never inside a word.

    The arrays that a byte costs (60 to 80 bytes) are so held for one part of a text at a time, however long it is; only a
    single word of more bytes is as long as it is.
    """
    start = 0
    while start < len(data):
        end = min(len(data), start + most)
        while end < len(data):
            found = np.flatnonzero(blank[data[end : end + most]])
            if len(found):
                end += int(found[0])
                break
            end = min(len(data), end + most)
        yield start, end
        start = end


def count_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of words of each text."""
    if len(data) == 0:
        return np.zeros(len(offsets) - 1, np.int64)
    begins = ~BLANK[data]
    inside = begins[:-1].copy()
    inside[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))] - 1] = False
    begins[1:] &= ~inside
    return np.diff(np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])[offsets])


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the range of its words (one more than texts)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~blank[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    return mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(U) * U(0xD6E8FEB86659FD93))
