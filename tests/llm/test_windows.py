"""Repeated word windows and aligned tokens against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sellerscope.llm import alignment, repeated_windows
from sellerscope.llm.alignment import align, gallop
from sellerscope.llm.repeated_windows import remove_repeated_windows

BYTE_PAIRS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def plainly_cut(docs, size=13):
    """{doc_id: (n_words, n_removed, kept)} of (doc_id, text) rows."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            least = first.get(tuple(w[k : k + size]))
            if least is not None and (i is None or least < i):
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def text_rows():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    random = lambda n: " ".join(rng.choice(words, n))
    passage, common = random(60), random(13)
    rows = [(i, f"{random(30)}\n{passage if i % 3 == 0 else common}  {random(5)}") for i in range(10, 40)]
    rows += [(3, random(12)), (4, random(13)), (50, random(20) + " " + passage[:200] + " É " + common.upper())]
    rows += [(60, (common + " ") * 40), (61, passage + " " + passage), (62, random(20_000) + " " + passage)]
    return rows + [rows[5], (rows[6][0], rows[7][1]), (None, passage + " x"), (None, "only here " * 9)]


def test_windows_equal_plain_python(documents, staged, edge_rows):
    rows = text_rows() + [(1000 + (i or 0), t) for i, t in edge_rows]
    found = remove_repeated_windows(documents(rows), staged).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found), key=str)
    assert got == sorted(plainly_cut(rows), key=str)
    for r in found:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_windows_with_a_crowded_sketch_and_many_parts(documents, staged, monkeypatch):
    """Estimates that are far too high, blocks and hash ranges of a few windows: the same rows."""
    rows = text_rows()
    monkeypatch.setattr(repeated_windows, "BLOCK_BITS", 6)
    monkeypatch.setattr(repeated_windows, "CELLS", 1)
    monkeypatch.setattr(repeated_windows, "RANGE_WINDOWS", 500)
    found = remove_repeated_windows(documents(rows), staged).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found), key=str)
    assert got == sorted(plainly_cut(rows), key=str)


def test_windows_of_an_empty_table(documents, staged):
    assert remove_repeated_windows(documents([]), staged).collect() == []


def test_gallop_finds_ranks():
    rng = np.random.default_rng(6)
    for n, m in ((0, 5), (5, 0), (1, 1), (40, 300), (300, 40), (500, 500)):
        x, y = (np.unique(rng.integers(0, 900, k)) for k in (n, m))
        guess = rng.integers(-5, m + 5, len(x))
        assert gallop(x, y, guess).tolist() == np.searchsorted(y, x).tolist()


def plainly_aligned(rows):
    """[(doc_id, counts..., groups)] of (doc_id, text) rows."""
    first = Tokenizer.from_file(BYTE_PAIRS)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in plain}
    byte |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}

    def tokens(ids, entry):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(entry(i))))
            at += len(entry(i))
        return out

    def piece(i):
        name = second.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if re.fullmatch("<0x..>", name) else name.replace("▁", " ").encode()

    pair_byte = lambda i: bytes(byte[c] for c in first.id_to_token(i))
    held, docs = [], Counter()
    for _, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(map(pair_byte, a)) != whole or b"".join(map(piece, b)) != whole:
            a, b = [], []
        a, b = tokens(a, pair_byte), tokens(b, piece)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        docs.update(set(links))
        held.append((a, b, links))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for (i, _), (a, b, links) in zip(rows, held):
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        cut = [[",".join(str(x[0]) for x in side if p < x[2] <= q) for side in (a, b)] for p, q in zip([0, *ends], ends)]
        figures = (len(a), len(b), len(ends), len(links), sum(docs[x] == most[x[0]] for x in links), sum(docs[x] for x in links))
        out.append((i, *figures, ";".join("|".join(g) for g in cut)))
    return out


TEXTS = [
    "Plain words, and numbers 12345 6789!",
    "Plain words again; don't   split  these ",
    "  naïve café — 日本語のテキスト ",
    "x<s></s><|endoftext|>\n\n\tend",
    "▁ is a sign",
    "tab\tand\rcarriage\x00null",
    "antidisestablishmentarianism " * 30,
    "aaaaaaaaaa" * 300,
]


@pytest.mark.parametrize("part_bytes", [alignment.PART_BYTES, 40])
def test_alignment_equals_plain_python(documents, staged, edge_rows, monkeypatch, part_bytes):
    monkeypatch.setattr(alignment, "PART_BYTES", part_bytes)
    rows = list(enumerate(TEXTS, 100)) + edge_rows
    found = align(documents(rows), BYTE_PAIRS, PIECES, staged).collect()
    assert sorted(map(tuple, found), key=str) == sorted(plainly_aligned(rows), key=str)


def test_alignment_of_an_empty_table(documents, staged):
    assert align(documents([]), BYTE_PAIRS, PIECES, staged).collect() == []


def test_digests_follow_from_groups(documents, staged):
    found = align(documents([(1, "one two"), (2, None)]), BYTE_PAIRS, PIECES, staged).collect()
    shown = {r["doc_id"]: r["groups"] for r in found}
    assert shown[2] == "" and re.fullmatch(r"[\d,]+\|[\d,]+(;[\d,]+\|[\d,]+)*", shown[1])
    assert len(hashlib.sha256(shown[1].encode()).hexdigest()) == 64


def test_alignment_holds_the_links_of_a_few_documents_at_once(monkeypatch):
    kinds = alignment._Kinds(BYTE_PAIRS, PIECES, "<u2", "<u2")
    texts = [f"number {i % 7} of the repeated words" for i in range(60)] + [""]
    rows = pa.RecordBatch.from_arrays([pa.array(range(61)), pa.array(texts)], ["doc_id", "text"])
    table = pa.Table.from_batches(kinds.encoded(iter([rows])))
    table = table.add_column(0, "part", pa.array([5] * 61, pa.int64()))
    pairs = alignment._pairs(kinds)(table)
    counts = pa.table({"pair": pairs["pair"], "n": pairs["n_docs"], "best": pa.array([i % 2 == 0 for i in range(len(pairs))])})
    whole = alignment._described(kinds)(table, counts)

    held, linked = [], alignment._Part.linked
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 200)
    monkeypatch.setattr(alignment._Part, "linked", lambda part: held.append(len(part.sizes[0])) or linked(part))
    assert alignment._pairs(kinds)(table).to_pydict() == pairs.to_pydict()
    assert alignment._described(kinds)(table, counts).to_pydict() == whole.to_pydict()
    assert sum(held) == 2 * 61 and max(held) < 20


def test_remembered_words_are_packed():
    """A worker keeps two bytes for an id of a word, not a number object."""
    tokenizer, library = alignment.Pieces(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in ("one two  three two", " \n", "é日本 word", "a" * 100):
        assert tokenizer.encode(text) == np.array(library.encode(text), "<u2").tobytes()
    assert all(isinstance(ids, bytes) and len(ids) % 2 == 0 for ids in tokenizer.words.values())
    assert "two" in tokenizer.words and "a" * 100 not in tokenizer.words
