"""Removal of repeated word windows with a count-min prefilter.

Every word covered by a window of ``WINDOW`` words goes if the window's words also start in a document of a smaller id.

1. Texts are written in parts (see ``parts``). A part counts its windows in a count-min sketch of two rows. The
   sketch is as wide as the corpus asks for, at least ``CELLS`` cells for each window, so a part writes only the cells it
   uses: sorted, as packed differences, one message for each block of cells.
2. Sketches are merged block by block, counts stop at two. The part is told, by a bit for each cell that it sent, whether
   the merged count is above one. A window whose cells all are is estimated to repeat; the estimate is never
   too low, so no repeated window is lost.
3. Only those windows are grouped exactly: a part sends each of them once, as 96 bits of its words' hash and its smallest
   document id, to the task of its hash range, which answers with a bit: whether a smaller id has the window.
4. A part then marks its windows and cuts the words that they cover.

A window in a third of all documents is one entry of a message for each part, so no key gathers rows of documents.
Messages of a block or hash range are held by one task: their number of blocks grows with the corpus.

Defined results: null, empty and blank texts have no words; repeated rows and rows of equal ids remove nothing from each
other; rows without an id remove nothing from others and lose what also starts in a document with an id. Texts
of fewer words than a window are kept. An empty table gives no rows. Extra columns do not take part. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerscope.llm.parts import Batches, bucketed, numbered, text_bytes

WINDOW = 13
CELLS = 4  # cells of a sketch row for each window of the corpus, at least
BLOCK_BITS = 22  # cells of a sketch block, as a power of two
RANGE_WINDOWS = 1 << 20  # windows of the corpus for each hash range, about
_WORDS_KEPT = 200_000  # hashes of words a worker remembers
_NO_ID = np.iinfo(np.int64).max
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)

Staged = Callable[[DataFrame, str], DataFrame]

_MESSAGE = "part bigint, bucket bigint, body binary"
_REPLY = "part bigint, kind int, bucket bigint, bits binary"


class _Words(dict):
    """Hash of a word, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_known = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text; on bytes, split() knows the six ASCII white spaces only."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


@dataclass(frozen=True)
class _Shape:
    """Powers of two: cells of a sketch row, cells of a block, and hash ranges."""

    bits: int
    block_bits: int
    range_bits: int

    def blocks(self, cells: np.ndarray, row: int) -> list[tuple[int, int, int]]:
        """(bucket, begin, end) of each block of sorted cells."""
        block = cells >> np.uint64(self.block_bits)
        begin = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(cells) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(cells))
        number = (row << (self.bits - self.block_bits)) + block[begin].astype(np.int64)
        return list(zip(number.tolist(), begin.tolist(), end.tolist(), strict=True))

    def packed(self, cells: np.ndarray) -> bytes:
        """Sorted cells of a block as differences, high and low bytes apart."""
        local = (cells & np.uint64((1 << self.block_bits) - 1)).astype(np.int64)
        steps = np.diff(local, prepend=0).astype("<u4")
        return zstandard.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


@dataclass
class _Windows:
    """Windows of the texts of a part: document number and first word of each, and two hashes of its words."""

    sizes: np.ndarray
    starts: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    h: np.ndarray
    g: np.ndarray

    @classmethod
    def of(cls, texts: pa.ChunkedArray) -> _Windows:
        if len(_known) > _WORDS_KEPT:
            _known.clear()
        hashed = []
        for text in texts:
            words = words_of(text.as_py())
            hashed.append(np.fromiter(map(_known.__getitem__, words), np.uint64, len(words)))
        sizes = np.array([len(x) for x in hashed], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.concatenate([np.zeros(0, np.uint64), *hashed])
        n = np.maximum(sizes - WINDOW + 1, 0)
        doc = np.repeat(np.arange(len(sizes)), n)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + starts[doc]
        out = []
        for values, base in zip((flat, _mixed(flat + np.uint64(1))), _BASES, strict=True):
            total = np.zeros(max(len(flat) - WINDOW + 1, 0), np.uint64)
            for i in range(WINDOW):
                total *= np.uint64(base)
                total += values[i : i + len(total)]
            out.append(_mixed(total[at]))
        return cls(sizes, starts, doc, at, *out)

    def cells(self, bits: int) -> list[np.ndarray]:
        """The windows' cells in each row of a sketch of 2**bits cells."""
        return [x >> np.uint64(64 - bits) for x in (self.h, self.g)]


def _unpacked(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(body), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def _sketched(shape: _Shape):
    def run(table: pa.Table) -> pa.Table:
        """The sketch of one part: its cells by block, cells used more than once twice."""
        out = []
        for row, cells in enumerate(_Windows.of(table["text"]).cells(shape.bits)):
            cells = np.sort(cells)
            once = np.ones(len(cells), bool)
            once[2:] = cells[2:] != cells[:-2]
            cells = cells[once]
            out += [(bucket, shape.packed(cells[a:b])) for bucket, a, b in shape.blocks(cells, row)]
        return _messages(table, out)

    return run


def _messages(table: pa.Table, out: list[tuple[int, bytes]]) -> pa.Table:
    part = table["part"][0].as_py()
    columns = [pa.array([part] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())]
    return pa.Table.from_arrays(columns, ["part", "bucket", "body"])


def _replies(table: pa.Table, kind: int, flags: list[np.ndarray]) -> pa.Table:
    columns = [table["part"], pa.array([kind] * len(flags), pa.int32()), table["bucket"], pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())]
    return pa.Table.from_arrays(columns, ["part", "kind", "bucket", "bits"])


def _cells(body: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """The different cells of a message, and how often it has each."""
    found = _unpacked(body.as_py())
    first = np.concatenate([[True], found[1:] != found[:-1]])
    return found[first], np.diff(np.append(np.flatnonzero(first), len(found))).astype(np.uint8)


def _merged(shape: _Shape):
    def run(table: pa.Table) -> pa.Table:
        """For each part of a block and each different cell it sent, whether the merged count is above one."""
        counts = np.zeros(1 << shape.block_bits, np.uint8)
        for body in table["body"]:
            cells, times = _cells(body)
            counts[cells] = np.minimum(counts[cells] + times, 2)
        return _replies(table, 0, [counts[_cells(body)[0]] > 1 for body in table["body"]])

    return run


def _told(replies: pa.Table, kind: int, sizes: dict[int, int]) -> np.ndarray:
    """The bits told to a part, put together in the order of buckets; ``sizes`` has the bits of each."""
    mine = replies.filter(pc.equal(replies["kind"], kind))
    bits = dict(zip(mine["bucket"].to_pylist(), mine["bits"].to_pylist(), strict=True))
    flags = [np.unpackbits(np.frombuffer(bits[b], np.uint8), count=n) for b, n in sizes.items()]
    return np.concatenate([np.zeros(0, np.uint8), *flags]).astype(bool)


@dataclass
class _Candidates:
    """Windows of a part that the sketch estimates to repeat, grouped by their words."""

    windows: _Windows
    ids: np.ndarray
    which: np.ndarray  # windows in order of group
    group: np.ndarray  # group of each
    first: np.ndarray  # in ``which``, of each group: the window of the smallest id

    @classmethod
    def of(cls, table: pa.Table, replies: pa.Table, shape: _Shape) -> _Candidates:
        windows = _Windows.of(table["text"])
        ids = pc.fill_null(table["doc_id"], _NO_ID).to_numpy().astype(np.int64)
        hot = np.ones(len(windows.doc), bool)
        sizes: dict[int, int] = {}
        rows = []
        for row, cells in enumerate(windows.cells(shape.bits)):
            distinct, back = np.unique(cells, return_inverse=True)
            sizes |= {bucket: b - a for bucket, a, b in shape.blocks(distinct, row)}
            rows.append((len(distinct), back))
        told, at = _told(replies, 0, sizes), 0
        for n, back in rows:
            hot &= told[at : at + n][back]
            at += n
        which = np.flatnonzero(hot)
        h, g = windows.h[which], windows.g[which]
        which = which[np.lexsort((ids[windows.doc[which]], g, h))]
        h, g = windows.h[which], windows.g[which]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(which) else np.zeros(0, bool)
        return cls(windows, ids, which, np.cumsum(new) - 1, np.flatnonzero(new))

    def ranges(self, shape: _Shape) -> list[tuple[int, int, int]]:
        """(bucket, begin, end) of the groups of each hash range."""
        h = self.windows.h[self.which[self.first]]
        bits = shape.range_bits
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(h) else np.zeros(0, np.int64)
        return list(zip(bucket[begin].tolist(), begin.tolist(), np.append(begin[1:], len(h)).tolist(), strict=True))


_ENTRY = np.dtype([("h", "<u8"), ("g", "<u4"), ("doc", "<i8")])


def _suspected(shape: _Shape):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        """Each window estimated to repeat, once, with the smallest id that has it in the part."""
        found = _Candidates.of(table, replies, shape)
        at = found.which[found.first]
        w = found.windows
        h, g, doc = w.h[at], w.g[at].astype(np.uint32), found.ids[w.doc[at]]
        out = []
        for bucket, a, b in found.ranges(shape):
            out.append((bucket, h[a:b].astype("<u8").tobytes() + g[a:b].astype("<u4").tobytes() + doc[a:b].astype("<i8").tobytes()))
        return _messages(table, out)

    return run


def _grouped(table: pa.Table) -> pa.Table:
    """For each part of a hash range and each window it sent, whether another part has it in a smaller id."""
    bodies = [x.as_py() for x in table["body"]]
    sizes = np.array([len(x) // _ENTRY.itemsize for x in bodies], np.int64)
    entries = np.zeros(int(sizes.sum()), _ENTRY)
    at = 0
    for body, n in zip(bodies, sizes.tolist(), strict=True):
        entries["h"][at : at + n] = np.frombuffer(body, "<u8", n)
        entries["g"][at : at + n] = np.frombuffer(body, "<u4", n, 8 * n)
        entries["doc"][at : at + n] = np.frombuffer(body, "<i8", n, 12 * n)
        at += n
    order = np.lexsort((entries["doc"], entries["g"], entries["h"]))
    e = entries[order]
    new = np.ones(len(e), bool)
    new[1:] = (e["h"][1:] != e["h"][:-1]) | (e["g"][1:] != e["g"][:-1])
    least = e["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.zeros(len(e), bool)
    later[order] = e["doc"] > least
    return _replies(table, 1, np.split(later, np.cumsum(sizes)[:-1]))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _cut(shape: _Shape):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        """Words, removed words, runs of them, and what is kept, of every text of a part."""
        found = _Candidates.of(table, replies, shape)
        w, ranges = found.windows, found.ranges(shape)
        later = _told(replies, 1, {bucket: b - a for bucket, a, b in ranges})
        own = found.ids[w.doc[found.which]]
        marked = found.which[later[found.group] | (own > own[found.first][found.group])]
        change = np.zeros(int(w.sizes.sum()) + 1, np.int64)
        np.add.at(change, w.at[marked], 1)
        np.add.at(change, w.at[marked] + WINDOW, -1)
        gone = np.cumsum(change)[:-1] > 0
        out = []
        for text, a, n in zip(table["text"], w.starts.tolist(), w.sizes.tolist(), strict=True):
            words, mine = words_of(text.as_py()), gone[a : a + n]
            edges = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0))
            if len(edges):
                words = list(compress(words, (~mine).tolist()))
            spans = [{"start": x, "stop": y} for x, y in edges.reshape(-1, 2).tolist()]
            out.append((n, int(mine.sum()), b" ".join(words).decode("utf-8", "surrogatepass"), spans))
        kinds = [pa.int64(), pa.int64(), pa.string(), _SPANS]
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
        return pa.Table.from_arrays([table["doc_id"], *columns], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return run


def _with_guess(batches: Batches) -> Batches:
    """Adds about how many words a text has: its blanks and line breaks."""
    for batch in batches:
        text = pc.fill_null(batch.column(2), "")
        guess = pc.add(pc.count_substring(text, " "), pc.count_substring(text, "\n"))
        yield pa.RecordBatch.from_arrays([*batch.columns, guess.cast(pa.int64())], [*batch.schema.names, "guess"])


def remove_repeated_windows(docs: DataFrame, staged: Staged, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans) of every row of ``docs``; spans are ranges of words that go, ``kept`` joins the others."""
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    number = numbered(text_bytes(1))
    parts = rows.mapInArrow(lambda batches: _with_guess(number(batches)), "part bigint, doc_id bigint, text string, guess bigint")
    parts = bucketed(parts, "window-parts")
    windows = parts.agg(F.sum("guess")).first()[0] or 0
    bits = max(int(CELLS * windows).bit_length(), BLOCK_BITS)
    shape = _Shape(bits, BLOCK_BITS, int(windows // RANGE_WINDOWS).bit_length())
    texts = parts.select("part", "doc_id", "text")

    sketches = texts.groupBy("part").applyInArrow(_sketched(shape), _MESSAGE)
    counted = sketches.groupBy("bucket").applyInArrow(_merged(shape), _REPLY)
    repeated = staged(counted, "window-counts")

    def meet(replies: DataFrame, function, schema: str) -> DataFrame:
        return texts.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(function, schema)

    suspected = meet(repeated, _suspected(shape), _MESSAGE)
    exact = suspected.groupBy("bucket").applyInArrow(_grouped, _REPLY)
    out = "doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<start:bigint,stop:bigint>>"
    return meet(repeated.union(exact), _cut(shape), out)
