"""Alignment of the tokens that two tokenizers make of the same texts.

Both token lists of a text cover the same bytes, so they are aligned by the bytes where tokens end:

1. Texts are encoded once; ids go to parts (see ``parts``), which the later passes read in place of texts.
2. Of the two lists of ends the shorter drives: each of its ends starts a galloping search in the longer list, at
   the place its own rank suggests, doubles its step until it has passed the end, and halves the bracket.
   Ends in both lists cut the tokens into groups. The rank an end has in the longer list, less the rank of the end before
   it, is the range of tokens that its token overlaps: the links.
3. Links are counted by document for each pair of ids, first inside a part, then over the corpus. A part gets the counts
   of its own pairs back, so neither texts nor links move, and a pair in every document is a row for each part.

Groups are written ``a1,a2|b1;a3|b2,b3``: ids of the one tokenizer, then of the other, group by group.

Defined results: null and empty texts, and texts that one of the tokenizers does not give back byte for byte, have no
tokens, groups or links. Repeated rows and rows without an id count as documents of their own. An empty table gives no rows.
Extra columns do not take part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sellerscope.llm.encoding import TextEncoder, byte_characters
from sellerscope.llm.parts import Batches, bucketed, numbered

PART_BYTES = 4 << 20  # of ids; bounds the table that a task is given
BLOCK_BYTES = 512 << 10  # of ids aligned at once, in whole documents; bounds the links that a task holds
_WORDS_KEPT, _WORD_CHARS = 300_000, 64  # words whose ids a worker remembers, and their greatest length
_SPACE = "▁"

Staged = Callable[[DataFrame, str], DataFrame]


class BytePairs(TextEncoder):
    """The byte-level tokenizer; special strings in texts are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.special = re.compile(r"(?!)")
        self.library.encode_special_tokens = True
        back = {c: b for b, c in byte_characters().items()}
        with open(path, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        self.bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()


class _Words(dict):
    """Packed ids of a blank and a word, by the word, encoded when first asked for."""

    def __init__(self, encoded: Callable[[str], bytes]):
        super().__init__()
        self.encoded = encoded

    def __missing__(self, word: str) -> bytes:
        ids = self.encoded(word)
        if len(word) <= _WORD_CHARS:
            self[word] = ids
        return ids


class Pieces:
    """The sentence-piece tokenizer; ids are packed as numbers of ``kind``.

    No entry of its vocabulary goes on past a blank, so blanks and the word behind them are encoded on their own, and
    each kind of them once. A vocabulary with such an entry is applied to whole texts.
    """

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = _id_type(self.library.vocab_size())
        names = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace(_SPACE, " ").encode() for p in names]
        self.by_word = not any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in names)
        self.blank = self._packed([self.library.piece_to_id(_SPACE)])
        self.words = _Words(self._whole)

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._packed(self.library.encode(text))

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._whole(text)
        if len(self.words) > _WORDS_KEPT:
            self.words.clear()
        words = text.split(" ")
        if "" not in words:
            return b"".join(map(self.words.__getitem__, words))
        return b"".join(self.blank if run == " " else self.words[run[1:]] for run in re.findall(" +[^ ]*", " " + text))


@lru_cache(maxsize=1)
def _tokenizers(path_a: str, path_b: str) -> tuple[BytePairs, Pieces]:
    return BytePairs(path_a), Pieces(path_b)


@dataclass(frozen=True)
class _Kinds:
    """Paths of the two vocabularies and how ids of them are stored."""

    a: str
    b: str
    type_a: str
    type_b: str

    def tables(self) -> tuple[BytePairs, Pieces]:
        return _tokenizers(self.a, self.b)

    def encoded(self, batches: Batches) -> Batches:
        """(doc_id, a, b): ids of both tokenizers, none where they do not give the text back."""
        first, second = self.tables()
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            texts = batch.column(1).to_pylist()
            spaced = [" " + t if t else None for t in texts]
            out = []
            for i, ids in first.encode(spaced, 0):
                a, b = ids[:-1], second.encode(texts[i]) if texts[i] else b""
                whole = spaced[i].encode("utf-8", "surrogatepass") if texts[i] else b""
                told = np.frombuffer(b, second.kind).tolist()
                same = b"".join(map(first.bytes.__getitem__, a.tolist())) == whole and b"".join(map(second.bytes.__getitem__, told)) == whole
                out.append((a.astype(self.type_a).tobytes(), np.frombuffer(b, second.kind).astype(self.type_b).tobytes()) if same else (b"", b""))
            columns = [pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "a", "b"])


def gallop(values: np.ndarray, into: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """How many of the sorted ``into`` are below each of ``values``, searched from ``guess`` with doubling steps."""
    n = len(into)
    low, high = np.full(len(values), -1), np.full(len(values), n)  # into[low] < value <= into[high]
    if not n:
        return np.zeros(len(values), np.int64)
    at = np.clip(guess, 0, n - 1)
    below = into[at] < values
    low[below], high[~below] = at[below], at[~below]
    step = 1
    active = np.arange(len(values))
    while len(active):  # the open side of the bracket, a step further each time
        up = below[active]
        next_ = np.where(up, at[active] + step, at[active] - step)
        inside = (next_ >= 0) & (next_ < n)
        active, up, next_ = active[inside], up[inside], next_[inside]
        passed = into[next_] >= values[active]
        high[active[passed]] = next_[passed]
        low[active[~passed]] = next_[~passed]
        active = active[passed != up]
        at[active] = next_[passed != up]
        step *= 2
    active = np.flatnonzero(high - low > 1)
    while len(active):
        middle = (low[active] + high[active]) // 2
        less = into[middle] < values[active]
        low[active[less]], high[active[~less]] = middle[less], middle[~less]
        active = active[high[active] - low[active] > 1]
    return high


@dataclass
class _Part:
    """The tokens of a part, document after document, and how those of some documents are linked."""

    ids: tuple[np.ndarray, np.ndarray]
    sizes: tuple[np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, table: pa.Table, kinds: _Kinds) -> _Part:
        ids, sizes, ends = [], [], []
        for column, kind, tokenizer in (("a", kinds.type_a, kinds.tables()[0]), ("b", kinds.type_b, kinds.tables()[1])):
            bodies = table[column].to_pylist()
            found = np.frombuffer(b"".join(bodies), kind).astype(np.int64)
            lengths = _lengths(kinds, column, tokenizer.bytes)
            ids.append(found)
            sizes.append(np.array([len(x) for x in bodies], np.int64) // np.dtype(kind).itemsize)
            ends.append(np.cumsum(lengths[found]))
        return cls(tuple(ids), tuple(sizes), tuple(ends))

    def linked(self) -> tuple[np.ndarray, ...]:
        """Document, A token and B token of every link, documents together; and which tokens end a group."""
        n = len(self.sizes[0])
        short_b = self.sizes[1] < self.sizes[0]
        links, common = [], [np.zeros(len(x), bool) for x in self.ids]
        for drives, chosen in ((0, ~short_b), (1, short_b)):
            other = 1 - drives
            mine = [np.flatnonzero(np.repeat(chosen, s)) for s in self.sizes]
            x, y = self.ends[drives][mine[drives]], self.ends[other][mine[other]]
            if not len(x):
                continue
            doc = np.repeat(np.arange(n), np.where(chosen, self.sizes[drives], 0))
            counts = [np.where(chosen, s, 0) for s in self.sizes]
            begin = [np.cumsum(c) - c for c in counts]
            rank = np.arange(len(x)) - begin[drives][doc]
            guess = begin[other][doc] + rank * counts[other][doc] // counts[drives][doc]
            below = gallop(x, y, guess)
            hit = y[below] == x
            common[drives][mine[drives][hit]] = True
            common[other][mine[other][below[hit]]] = True
            upto = below + hit
            first = np.concatenate([[0], upto[:-1]])
            many = below + 1 - first
            k = np.repeat(np.arange(len(x)), many)
            m = np.arange(len(k)) - np.repeat(np.cumsum(many) - many - first, many)
            pair = [None, None]
            pair[drives], pair[other] = mine[drives][k], mine[other][m]
            links.append((doc[k], *pair))
        empty = np.zeros(0, np.int64)
        return (*(np.concatenate([empty, *(x[i] for x in links)]) for i in range(3)), *common)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.ids[0][a] << 32 | self.ids[1][b]


def _blocks(table: pa.Table) -> Iterator[pa.Table]:
    """The documents of a part, in order, some at a time."""
    sizes = sum(pc.fill_null(pc.binary_length(table[c]), 0).to_numpy().astype(np.int64) for c in ("a", "b"))
    block = (np.cumsum(sizes) - sizes) // BLOCK_BYTES
    ends = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    return (table.slice(i, j - i) for i, j in zip(ends, ends[1:]))


_LENGTHS: dict[tuple[str, str], np.ndarray] = {}


def _lengths(kinds: _Kinds, column: str, entries: list[bytes]) -> np.ndarray:
    key = (kinds.a, kinds.b, column)
    if key not in _LENGTHS:
        _LENGTHS[key] = np.array([len(x) for x in entries], np.int64)
    return _LENGTHS[key]


@lru_cache(maxsize=4)
def _written(size: int) -> list[np.ndarray]:
    """Decimal ids of a vocabulary, followed by a comma, a bar and a semicolon."""
    return [np.array([f"{i}{end}" for i in range(size)], object) for end in ",|;"]


def _groups(part: _Part, common_a: np.ndarray, common_b: np.ndarray, size: int) -> list[str]:
    """The groups of every document as text."""
    (a, b), (sizes_a, sizes_b) = part.ids, part.sizes
    group_a, group_b = (np.cumsum(c) - c for c in (common_a, common_b))
    upto_a, upto_b = np.flatnonzero(common_a) + 1, np.append(0, np.flatnonzero(common_b) + 1)
    at_a = np.arange(len(a)) + upto_b[group_a]
    at_b = np.arange(len(b)) + upto_a[group_b]
    comma, bar, semicolon = _written(size)
    out = np.empty(len(a) + len(b), object)
    out[at_a] = np.where(common_a, bar[a], comma[a])
    out[at_b] = np.where(common_b, semicolon[b], comma[b])
    ends = np.cumsum(sizes_a + sizes_b).tolist()
    listed = out.tolist()
    return ["".join(listed[i:j])[:-1] for i, j in zip([0, *ends], ends)]


def _linked_docs(table: pa.Table, kinds: _Kinds) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of ids, sorted, and in how many documents of ``table`` each of them is."""
    part = _Part.of(table, kinds)
    doc, a, b, _, _ = part.linked()
    pair = part.pairs(a, b)
    order = np.argsort(pair, kind="stable")  # links of a document stay together
    pair, doc = pair[order], doc[order]
    new = np.ones(len(pair), bool)
    new[1:] = pair[1:] != pair[:-1]
    once = new.copy()
    once[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    return pair[first], np.add.reduceat(once.astype(np.int64), first) if len(first) else first


def _pairs(kinds: _Kinds):
    def run(table: pa.Table) -> pa.Table:
        """(part, pair, n_docs): in how many documents of the part a pair of ids is linked."""
        found = [_linked_docs(block, kinds) for block in _blocks(table)]  # a document lies in one block
        pair, at = np.unique(np.concatenate([pairs for pairs, _ in found]), return_inverse=True)
        docs = np.zeros(len(pair), np.int64)
        np.add.at(docs, at, np.concatenate([n for _, n in found]))
        number = pa.array([table["part"][0].as_py()] * len(pair), pa.int64())
        return pa.Table.from_arrays([number, pa.array(pair), pa.array(docs)], ["part", "pair", "n_docs"])

    return run


_COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _described(kinds: _Kinds):
    def run(table: pa.Table, counts: pa.Table) -> pa.Table:
        """The groups of every document of a part, and what the corpus says of its links."""
        known, times, best = (counts[c].to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(known)
        known, times, best = known[order], times[order], best[order].astype(np.int64)
        size = max(len(t.bytes) for t in kinds.tables())

        def described(block: pa.Table) -> pa.Table:
            part = _Part.of(block, kinds)
            doc, a, b, common_a, common_b = part.linked()
            at = np.searchsorted(known, part.pairs(a, b))
            n = len(part.sizes[0])
            links = np.bincount(doc, minlength=n)
            order = np.argsort(doc, kind="stable")
            ends = np.append(0, np.cumsum(links))

            def summed(values: np.ndarray) -> np.ndarray:
                return np.diff(np.append(0, np.cumsum(values[at][order]))[ends])

            groups = np.bincount(np.repeat(np.arange(n), part.sizes[0])[common_a], minlength=n)
            figures = [*part.sizes, groups, links, summed(best), summed(times)]
            columns = [pa.array(f.astype(np.int64)) for f in figures]
            text = pa.array(_groups(part, common_a, common_b, size), pa.string())
            return pa.Table.from_arrays([block["doc_id"], *columns, text], ["doc_id", *_COUNTS, "groups"])

        return pa.concat_tables([described(block) for block in _blocks(table)])

    return run


def _id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def align(docs: DataFrame, byte_pairs: str, pieces: str, staged: Staged, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row of ``docs``.

    ``byte_pairs`` is the path of a byte-level vocabulary (A), ``pieces`` that of a sentence-piece model (B). ``n_best`` are the
    links whose pair is in as many documents as any pair of their A id; ``count_sum`` adds these counts over links.
    """
    sizes = Tokenizer.from_file(byte_pairs).get_vocab_size(), sentencepiece.SentencePieceProcessor(model_file=pieces).vocab_size()
    kinds = _Kinds(byte_pairs, pieces, *map(_id_type, sizes))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    number = numbered(lambda b: np.array([len(x) + len(y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())], np.int64), PART_BYTES)
    parts = bucketed(rows.mapInArrow(lambda b: number(kinds.encoded(b)), f"part bigint, doc_id {kind}, a binary, b binary"), "token-parts")

    pairs = staged(parts.groupBy("part").applyInArrow(_pairs(kinds), "part bigint, pair bigint, n_docs bigint"), "token-pairs")
    counts = pairs.groupBy("pair").agg(F.sum("n_docs").alias("n")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    told = pairs.select("part", "pair").join(counts, "pair")
    out = ", ".join([f"doc_id {kind}", *[f"{c} bigint" for c in _COUNTS], "groups string"])
    return parts.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_described(kinds), out)
