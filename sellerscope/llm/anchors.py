"""Anchors of byte strings: grams picked so that equal stretches pick the same ones.

Of all ``GRAM``-byte grams in a window of ``LENGTH`` bytes the one of the smallest hash is the window's anchor, the
leftmost on ties. It depends on the window's bytes alone, so two equal windows have the same anchor at the same
place. The windows of one anchor start next to each other.
"""

from __future__ import annotations

import numpy as np

LENGTH = 200
GRAM = 32
REACH = LENGTH - GRAM
# Bytes handled at once; neighbouring parts overlap by a window.
PART_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_PLACE_BITS = 24


class Rolling:
    """Hashes of any stretch of a byte string, from sums of powers modulo 2**64."""

    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)
    _values = np.random.default_rng(200).integers(0, 1 << 63, 257, np.uint64) | np.uint64(1)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(self._powers) <= n:
            for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
                steps = np.full(max(n + 1, 1 << 16), base, np.uint64)
                steps[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(steps))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self._values[data] * self._powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (self.sums[stop] - self.sums[start]) * self._inverses[start]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(_BASE)
        return h ^ (h >> np.uint64(29))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values, from running minima of blocks of that width."""
    n = len(values)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = values
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(rolling: Rolling, size: int) -> tuple[np.ndarray, ...]:
    """Anchor place, its gram's hash, and first and last start of the windows it anchors, for a string of ``size`` bytes."""
    at = np.arange(size - GRAM + 1)
    grams = rolling.of(at, at + GRAM)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    keyed = (grams & ~low) | at.astype(np.uint64)
    least = window_minima(keyed, REACH + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], len(least)) - 1
    place = (least[first] & low).astype(np.int64)
    return place, grams[place], first, last
