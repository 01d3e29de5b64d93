"""Run-length BWT index over a set of byte strings, and the longest match of each place elsewhere.

Strings are laid end to end with separators and their suffixes sorted. Where the preceding symbol changes
from one suffix to the next, a run of the Burrows-Wheeler transform ends. The common prefix with the neighbour is worked
out at run ends only, the samples; inside a run, the place before has one symbol more in common, so going
through the text, a place without a sample has one symbol less than the place before it. That gives
the matching statistics of every place against all others in one stream over the text.
"""

from __future__ import annotations

import numpy as np

_FIRST = 7  # symbols of 9 bits in the first sort key


def _suffixes(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the length that is compared."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(_FIRST, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(_FIRST):
        key = (key << np.uint64(9)) | padded[i : i + n]
    length = _FIRST
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[False], ordered[1:] != ordered[:-1]])
        steps = np.cumsum(new)
        if steps[-1] == n - 1 or length >= n:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = steps.astype(np.uint64)
        behind = np.zeros(n, np.uint64)
        behind[: n - length] = rank[length:] + np.uint64(1)
        key = rank * np.uint64(n + 1) + behind
        length *= 2


def _common(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at ``a`` and ``b`` have in common, compared eight at a time."""
    n = len(symbols)
    left, right = np.append(symbols, np.int16(-1)), np.append(symbols, np.int16(-2))
    out = np.zeros(len(a), np.int64)
    open_, step = np.arange(len(a)), np.arange(8)
    while open_.size:
        done = out[open_, None] + step
        same = left[np.minimum(a[open_, None] + done, n)] == right[np.minimum(b[open_, None] + done, n)]
        run = np.where(same.all(axis=1), 8, same.argmin(axis=1))
        out[open_] += run
        open_ = open_[run == 8]
    return out


def _streamed(n: int, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A value for every place: the sample's, one less for each place behind it."""
    last = np.full(n, -1, np.int64)
    last[places] = places
    last = np.maximum.accumulate(last)
    sampled = np.zeros(n, np.int64)
    sampled[places] = values
    return np.where(last >= 0, sampled[last] - (np.arange(n) - last), 0)


def longest_elsewhere(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start of each string in the index, and for every place the longest match that starts elsewhere."""
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    starts = np.cumsum(sizes) - sizes
    symbols = np.frombuffer(b"\x00".join(strings) + b"\x00", np.uint8).astype(np.int16) + np.int16(1)
    symbols[starts + sizes - 1] = 0
    n = len(symbols)
    order = _suffixes(symbols)
    before = symbols[order - 1]
    change = before[1:] != before[:-1]
    # text places 0 and n - 1 have no place before or behind to follow: they are samples too
    first = np.flatnonzero(change | (order[1:] == 0) | (order[:-1] == 0))
    best = np.zeros(n, np.int64)
    for here, other in ((order[first + 1], order[first]), (order[first], order[first + 1])):
        values = _common(symbols, here, other)
        best = np.maximum(best, _streamed(n, here, values))
    return starts, best
