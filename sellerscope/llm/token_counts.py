"""Token counts of whole texts by heap-and-linked-list byte-pair merging.

A piece starts as one symbol a byte, linked to its neighbours. A heap holds the adjacent pairs that can
merge; the pair of the lowest rank, leftmost first, is popped, merged into its left symbol, and the two
pairs that this makes are pushed. The count is the symbols at the start minus the merges; no
identifiers come out. Pieces repeat, so a worker keeps the counts of those it has seen.

Null and empty texts have 0 bytes and 0 tokens. Rows are kept as they come, repeated rows included.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sellerscope.llm.pieces import PieceCache, blocks

TOKEN_LIMIT = 2048


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


class MergeCounter:
    """Counts tokens of pieces; ``merges`` in order of rank, ``suffix`` ends the last symbol of a piece."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str):
        symbols = byte_symbols()
        ids: dict[str, int] = {}
        for s in symbols:
            ids.setdefault(s, len(ids))
        self.inner = [ids[s] for s in symbols]
        for s in symbols:
            ids.setdefault(s + suffix, len(ids))
        self.last = [ids[s + suffix] for s in symbols]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            pair = tuple(ids.setdefault(s, len(ids)) for s in (a, b))
            self.pairs[pair] = (rank, ids.setdefault(a + b, len(ids)))

    def count(self, piece: bytes) -> int:
        n = len(piece)
        if n < 2:
            return n
        symbol = [self.inner[b] for b in piece]
        symbol[-1] = self.last[piece[-1]]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        right[-1] = -1
        get, heap = self.pairs.get, []
        for i in range(n - 1):
            if hit := get((symbol[i], symbol[i + 1])):
                heap.append((hit[0], i, hit[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, made = heapq.heappop(heap)
            j = right[i]
            # the pair may have changed since it was pushed
            if symbol[i] < 0 or j < 0 or (hit := get((symbol[i], symbol[j]))) is None or hit[1] != made:
                continue
            merges += 1
            symbol[i], symbol[j] = made, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
                if hit := get((made, symbol[right[j]])):
                    heapq.heappush(heap, (hit[0], i, hit[1]))
            if left[i] >= 0 and (hit := get((symbol[left[i]], made))):
                heapq.heappush(heap, (hit[0], left[i], hit[1]))
        return n - merges


class TextCounter:
    """Counts the tokens of texts as the vocabulary file's own library would."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merges = MergeCounter([tuple(m) for m in model["merges"]], model["end_of_word_suffix"] or "")
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(special) + ")" if special else r"(?!)()")
        self.cache = PieceCache(self._counts)
        self.library = Tokenizer.from_file(path)

    def _counts(self, pieces: list[str]) -> list[tuple[int]]:
        return [(self.merges.count(p.encode("utf-8", "surrogatepass")),) for p in pieces]

    @staticmethod
    def _normal(text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("\u03a3", "\u03c3")  # lower-cased by character, without a final form
        return text.lower()

    def _with_unassigned(self, text: str) -> int:
        """A text with characters that Unicode versions differ on: its pieces come from the library."""
        total = 0
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                total += 1
            else:
                normal = self.library.normalizer.normalize_str(part)
                back = {s: b for b, s in enumerate(byte_symbols())}
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
                    total += self.merges.count(bytes(back[c] for c in piece))
        return total

    def count(self, texts: list[str | None]) -> np.ndarray:
        totals = np.zeros(len(texts), np.int64)
        unsure: set[int] = set()

        def parts() -> Iterator[tuple[int, str]]:
            for i, text in enumerate(texts):
                for k, part in enumerate(self.special.split(text) if text else ()):
                    if k % 2:
                        totals[i] += 1
                    elif part:
                        yield i, self._normal(part)

        for block in blocks(parts()):
            unsure |= block.unsure()
            first, end = block.spans(joined_spaces=False)
            if first.size:
                counts = self.cache.gather(self.cache.lookup(block, first, end))
                totals += np.bincount(block.owner(first), counts, len(texts)).astype(np.int64)
        for i in unsure:
            totals[i] = self._with_unassigned(texts[i])
        return totals


@lru_cache(maxsize=2)
def _counter(path: str) -> TextCounter:
    return TextCounter(path)


def _counted(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            columns = [*batch.columns[:-1], n_bytes, pa.array(counter.count(texts.to_pylist()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = TOKEN_LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens exceed ``limit``.

    ``vocabulary`` is the place of a byte-pair file on every executor. One narrow pass: nothing is
    shuffled, and an executor holds one batch of rows and one block of characters at a time.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(_counted(vocabulary), f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
