"""Token ids of whole texts by a byte-level vocabulary file, piece by piece.

Every distinct piece of text is encoded by the tokenizers library once and kept by the worker; texts are
then put together from the ids of their pieces. A piece is what the vocabulary's pre-tokenizer would make of it, so it is
given to the library's model itself where nothing but byte-level pre-tokenization comes before the model. Texts that hold a
special string or characters that Unicode versions class differently are encoded by the library whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from sellerscope.llm.pieces import PieceCache, blocks


@lru_cache(maxsize=1)
def byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: from 256 on for bytes that do not print."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _model_alone(spec: dict) -> bool:
    """Whether a vocabulary file asks for byte-level pre-tokenization and its model, and for nothing else in a piece."""
    before = spec["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    return plain and not spec["normalizer"] and not spec["truncation"] and not spec["padding"] and all(t["special"] for t in spec["added_tokens"])


class TextEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special) or r"(?!)")
        self.library = Tokenizer.from_file(path)
        self.cache = PieceCache(self._by_model if _model_alone(spec) else self._encoded)

    def _encoded(self, pieces: list[str]) -> list[list[int]]:
        return [self.library.encode(p, add_special_tokens=False).ids for p in pieces]

    def _by_model(self, pieces: list[str]) -> list[list[int]]:
        tokenize, written = self.library.model.tokenize, byte_characters()
        return [[t.id for t in tokenize(p.encode().decode("latin-1").translate(written))] for p in pieces]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, texts: list[str | None], end_id: int) -> Iterator[tuple[int, np.ndarray]]:
        """(index, ids with ``end_id`` behind them) of every text, in order; null gives ``end_id`` alone."""
        end = np.array([end_id], np.int32)
        parts: dict[int, list[np.ndarray]] = {}
        unsure: set[int] = set()
        done = 0
        plain = [bool(t) and not self.special.search(t) for t in texts]

        def upto(stop: int) -> Iterator[tuple[int, np.ndarray]]:
            for i in range(done, stop):
                whole = texts[i] and (not plain[i] or i in unsure)
                held = [self._whole(texts[i])] if whole else parts.pop(i, [])
                parts.pop(i, None)
                yield i, np.concatenate([*held, end])

        for block in blocks((i, t) for i, t in enumerate(texts) if plain[i]):
            unsure |= block.unsure()
            first, stop = block.spans(joined_spaces=True)
            rows = self.cache.lookup(block, first, stop)
            ids = self.cache.gather(rows)
            owner = block.owner(first)
            docs, at = np.unique(owner, return_index=True)
            sums = np.append(np.add.reduceat(self.cache.sizes(rows), at), 0)
            ends = np.cumsum(sums[:-1])
            for d, a, b in zip(docs.tolist(), (ends - sums[:-1]).tolist(), ends.tolist(), strict=True):
                parts.setdefault(d, []).append(ids[a:b])
            last = int(block.owners[-1])  # may go on in the next block
            yield from upto(last)
            done = max(done, last)
        yield from upto(len(texts))


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)
