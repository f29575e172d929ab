"""Equal windows of a set of strings, by interval expansion on a Burrows-Wheeler transform.

Suffixes are sorted to the threshold's depth. From the transform, the intervals
of all strings of length 1, 2, 3, ... are reached breadth first by backward
extension; the end of an interval that is reached for the first time at length
l + 1 is a boundary of common prefix l. So common prefixes come by increasing
value, and the expansion stops at the threshold: what has no boundary by then
has a common prefix of the threshold or more.
"""

from __future__ import annotations

import numpy as np


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    step = np.zeros(len(keys), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=step[1:])
    del sorted_
    new = np.empty(len(keys), np.int32)
    new[order] = np.cumsum(step, dtype=np.int32)
    return new


def sort_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in the order of their first ``depth`` symbols (0 to 256; behind the end all are 0)."""
    n, size = len(symbols), min(7, depth)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(size, np.int64)])
    keys = np.zeros(n, np.int64)
    for i in range(size):
        keys = keys << 9 | padded[i : i + n]
    while True:
        if size >= depth:
            return np.argsort(keys, kind="stable").astype(np.int32)
        rank = _ranks(keys).astype(np.int64)
        step = min(size, depth - size)
        ahead = np.zeros(n, np.int64)
        if step < n:
            ahead[: n - step] = rank[step:] + 1
        keys = rank << 32 | ahead
        size += step


def boundaries(symbols: np.ndarray, order: np.ndarray, threshold: int, narrow: int = 48) -> np.ndarray:
    """For each place in ``order`` but the first, whether its common prefix with the one before is under ``threshold``.

    Only strings with a 0 at their end, if anywhere, are followed; so answers hold for suffixes that have no 0 in their
    first ``threshold`` symbols, and between these and their neighbours.
    """
    n = len(order)
    bwt = symbols[order - 1].astype(np.int64)  # the symbol before the first is the last one
    back = np.argsort(bwt.astype(np.uint16), kind="stable")
    last_first = np.empty(n, np.int32)
    last_first[back] = np.arange(n, dtype=np.int32)
    keys = bwt[back] * (n + 1) + back
    bwt = bwt.astype(np.int16)
    del back
    marked = np.zeros(n + 1, bool)
    marked[n] = True
    alphabet = np.unique(bwt)
    low, high = np.array([0]), np.array([n])
    for length in range(threshold):
        wide = high - low > narrow
        lows, highs = [], []
        if wide.any():
            for c in alphabet[alphabet > 0] if length else alphabet:
                a = np.searchsorted(keys, int(c) * (n + 1) + low[wide])
                b = np.searchsorted(keys, int(c) * (n + 1) + high[wide])
                some = b > a
                lows.append(a[some])
                highs.append(b[some])
        if not wide.all():
            size = (high - low)[~wide]
            which = np.repeat(np.arange(len(size)), size)
            rows = np.repeat(low[~wide] - np.cumsum(size) + size, size) + np.arange(size.sum())
            symbol = bwt[rows]
            if length:
                keep = symbol > 0
                which, rows, symbol = which[keep], rows[keep], symbol[keep]
            if len(rows):
                goes = last_first[rows]
                by = np.argsort(which * n + goes)
                which, goes, symbol = which[by], goes[by], symbol[by]
                first = np.ones(len(by), bool)
                first[1:] = (which[1:] != which[:-1]) | (symbol[1:] != symbol[:-1])
                at = np.flatnonzero(first)
                lows.append(goes[at])
                highs.append(goes[np.append(at[1:], len(by)) - 1] + 1)
        if not lows:
            break
        low, high = np.concatenate(lows), np.concatenate(highs)
        new = ~marked[high] if length else np.ones(len(high), bool)
        low, high = low[new], high[new]
        if length:
            high, at = np.unique(high, return_index=True)
            low = low[at]
        marked[high] = True
        if not len(low):
            break
    return marked[1:n]


def equal_windows(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of equal windows of ``size`` bytes inside the strings ``data[offsets[i]:offsets[i + 1]]``.

    Gives the windows' starts in ``data`` and their class numbers, both in class order.
    """
    lengths = np.diff(offsets)
    place = np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)  # one 0 behind each string
    symbols = np.zeros(len(data) + len(lengths), np.uint16)
    symbols[place] = data.astype(np.uint16) + 1
    whole = np.zeros(len(symbols), bool)
    whole[place] = np.repeat(offsets[1:], lengths) - np.arange(len(data)) >= size
    order = sort_suffixes(symbols, size)
    number = np.concatenate([[0], np.cumsum(boundaries(symbols, order, size))])
    keep = whole[order]
    at = np.full(len(symbols), -1, np.int64)
    at[place] = np.arange(len(data))
    return at[order[keep]], number[keep]
