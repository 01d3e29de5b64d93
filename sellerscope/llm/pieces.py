"""Pre-tokenization of whole texts with numpy: where the pieces are, and a key for each.

Texts of a batch are laid end to end, each followed by a sentinel, and cut into pieces by comparing
character classes of neighbours. A piece's key is a 64-bit polynomial hash of its characters; a second,
independent hash is kept beside it, so that a cached piece is only taken for another if 128 bits agree.
Work is done in blocks of about ``BLOCK_CHARS`` characters, whatever the length of a text: longer texts
are cut where a piece ends for certain.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

# Characters handled at once; bounds memory, not results.
BLOCK_CHARS = 500_000

WHITE, LETTER, NUMBER, OTHER, SENTINEL, UNSURE = range(6)
_END = 0x110000
_APOSTROPHE = ord("'")
# White space of the tokenizers' patterns.
_WHITE_SPACE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class by code point; unassigned ones are UNSURE, as libraries differ in their Unicode version."""
    table = np.full(_END + 1, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(_END):
        category = unicodedata.category(chr(c))
        if category == "Cn":
            table[c] = UNSURE
        elif category[0] in kinds:
            table[c] = kinds[category[0]]
    table[_WHITE_SPACE] = WHITE
    table[_END] = SENTINEL
    return table


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, ...]:
    """Powers of two odd bases and of their inverses modulo 2**64, and mixed values of characters."""
    out, n = [], 2 * BLOCK_CHARS
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
    values = np.random.default_rng(20240611).integers(0, 1 << 63, _END + 1, np.uint64) | np.uint64(1)
    return (*out, values)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Block:
    """Sections laid end to end: ``text`` with one sentinel place after each section."""

    def __init__(self, sections: list[str], owners: list[int]):
        self.text = "\x00".join(sections) + "\x00"  # the places of sentinels
        self.owners = np.asarray(owners, np.int64)
        cps = code_points(self.text).copy()
        self.ends = np.cumsum([len(s) + 1 for s in sections]) - 1
        cps[self.ends] = _END
        self.cps, self.cls = cps, classes()[cps]

    def unsure(self) -> set[int]:
        """Documents with characters whose class is not certain; their pieces are not to be used."""
        at = np.flatnonzero(self.cls == UNSURE)
        return set(self.owner(at).tolist())

    def _contractions(self, start: np.ndarray) -> None:
        """Cut 's 't 'm 'd 're 've 'll off where a piece starts with the apostrophe."""
        at = np.flatnonzero((self.cps == _APOSTROPHE) & start)
        if not at.size:
            return
        padded = np.concatenate([self.cps, np.full(3, _END, np.uint32)])
        one, two = padded[at + 1], padded[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        for mask, n in ((short, 2), (long, 3)):
            start[at[mask] + 1] = False
            start[at[mask] + n] = True

    def spans(self, joined_spaces: bool) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every piece.

        With ``joined_spaces`` a blank belongs to the word after it and other white space forms pieces;
        without, white space is dropped and every numeral is a piece of its own.
        """
        cls, n = self.cls, len(self.cls)
        start = np.ones(n, bool)
        start[1:] = cls[1:] != cls[:-1]
        if joined_spaces:
            # the last white space before a word: joined if it is a blank, else a piece of its own
            last = np.flatnonzero((cls[:-1] == WHITE) & (cls[1:] != WHITE) & (cls[1:] != SENTINEL))
            start[last] = True
            start[last[self.cps[last] == 32] + 1] = False
        else:
            start |= cls == NUMBER
        self._contractions(start)
        first = np.flatnonzero(start)
        end = np.append(first[1:], n)
        keep = cls[first] != SENTINEL
        if not joined_spaces:
            keep &= cls[first] != WHITE
        return first[keep], end[keep]

    def keys(self, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of every piece."""
        p1, i1, p2, i2, values = _powers()
        n, mixed = len(self.cps), values[self.cps]
        if n > len(p1):  # one piece longer than a block: powers for this block alone
            p1, i1, p2, i2 = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, p[1], np.uint64)]) for p in (p1, i1, p2, i2))
        out = []
        for powers, inverse in ((p1, i1), (p2, i2)):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mixed * powers[:n], out=sums[1:])
            out.append((sums[end] - sums[first]) * inverse[first])
        return out[0] ^ (out[1] >> np.uint64(29)), out[1]

    def owner(self, first: np.ndarray) -> np.ndarray:
        """The document each piece belongs to."""
        return self.owners[np.searchsorted(self.ends, first, side="left")]


def _cut(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` characters, cut before a white space that follows something else."""
    at = 0
    border = re.compile(r"\S(?= )")
    while len(text) - at > size:
        m = border.search(text, at + size)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def blocks(texts: Iterator[tuple[int, str]], size: int | None = None) -> Iterator[Block]:
    """Blocks of (document, text) in order; a long text may spread over several."""
    size = size or BLOCK_CHARS
    sections: list[str] = []
    owners: list[int] = []
    held = 0
    for owner, text in texts:
        for part in _cut(text, size):
            sections.append(part)
            owners.append(owner)
            held += len(part) + 1
            if held >= size:
                yield Block(sections, owners)
                sections, owners, held = [], [], 0
    if sections:
        yield Block(sections, owners)


class PieceCache:
    """Values of pieces seen before: a row of a flat pool, found by the piece's 128-bit key.

    ``values(strings)`` gives the values of each of the new pieces, a list of whole numbers for every one. Rows are found in a hash
    table of row numbers with open addressing, for all pieces of a block at once. At ``most`` pieces the cache starts
    anew, which costs time and changes no result.
    """

    def __init__(self, values, most: int = 800_000):
        self.values, self.most = values, most
        self._clear()

    def _clear(self) -> None:
        self.held = 0
        self.slots = np.full(1 << 13, -1, np.int32)
        self.keys = np.zeros(1 << 12, np.uint64)
        self.checks = np.zeros(1 << 12, np.uint64)
        self.offsets = np.zeros((1 << 12) + 1, np.int64)
        self.pool = np.zeros(1 << 14, np.int32)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        """Where the search for a key starts: the upper bits of a product, as many as slots need."""
        bits = len(self.slots).bit_length() - 1
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The row of every key, -1 for new ones."""
        at, last = self._slot(keys), len(self.slots) - 1
        rows = self.slots[at]
        left = np.flatnonzero((self.keys[rows] != keys) & (rows >= 0))
        while left.size:
            at[left] = (at[left] + 1) & last
            rows[left] = self.slots[at[left]]
            left = left[(self.keys[rows[left]] != keys[left]) & (rows[left] >= 0)]
        return rows.astype(np.int64)

    def _place(self, rows: np.ndarray) -> None:
        """Give new rows, whose keys differ, a slot each."""
        at, last = self._slot(self.keys[rows]), len(self.slots) - 1
        while rows.size:
            free = self.slots[at] < 0
            self.slots[at[free]] = rows[free]  # of several rows at a slot the last one gets it
            left = self.slots[at] != rows
            rows, at = rows[left], (at[left] + 1) & last

    def _add(self, keys: np.ndarray, checks: np.ndarray, strings: list[str]) -> None:
        found = self.values(strings)
        n, upto = self.held, self.held + len(keys)
        ends = self.offsets[n] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        self.keys, self.checks = self._room(self.keys, upto), self._room(self.checks, upto)
        self.offsets = self._room(self.offsets, upto + 1)
        self.pool = self._room(self.pool, int(ends[-1]))
        self.pool[self.offsets[n] : ends[-1]] = np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1] - self.offsets[n]))
        self.keys[n:upto], self.checks[n:upto] = keys, checks
        self.offsets[n + 1 : upto + 1] = ends
        self.held = upto
        if 2 * upto > len(self.slots):  # at most half full
            self.slots = np.full(1 << (4 * upto).bit_length(), -1, np.int32)
            n = 0
        self._place(np.arange(n, upto, dtype=np.int32))

    def lookup(self, block: Block, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The cache row of every piece; rows hold until the next lookup."""
        keys, checks = block.keys(first, end)
        if self.held > self.most:
            self._clear()
        rows = self._find(keys)
        new = np.flatnonzero(rows < 0)
        if new.size:
            _, where, back = np.unique(keys[new], return_index=True, return_inverse=True)
            at = new[where]
            strings = [block.text[a:b] for a, b in zip(first[at].tolist(), end[at].tolist(), strict=True)]
            base = self.held
            self._add(keys[at], checks[at], strings)
            rows[new] = base + back
        if (self.checks[rows] != checks).any():
            raise RuntimeError("two pieces share a 64-bit key; use other hash bases")
        return rows

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self.offsets[rows + 1] - self.offsets[rows]

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The values of all rows, one after the other."""
        sizes = self.sizes(rows)
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.int32)
        return self.pool[np.repeat(self.offsets[rows] - ends + sizes, sizes) + np.arange(ends[-1])]
