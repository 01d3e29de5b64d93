import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
import pytest
from tokenizers import Tokenizer

from sellerscope.llm import packing, pieces, token_counts, token_files
from sellerscope.llm.encoding import TextEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
POOLS = ["'s't're've'm'll'd' ", "abc XYZ\n\t  ", "0123½²Ⅷ", "!?'\"--", "éÉßİΣσςÀ́", "日本語한국어 　 \u0085", "😀🏽‍", "\x00\x1c͸", "ẛ̣ﬁǅ"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    specials = ["<|endoftext|>", "<|startoftext|>", "'ll", "'re", " 's"]
    pick = lambda: rng.choice(rng.choice(POOLS)) if rng.random() < 0.97 else rng.choice(specials)
    return ["".join(pick() for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_counts_equal_the_library():
    texts = [*random_texts(3000), None, "", " "]
    library = Tokenizer.from_file(WORDS)
    expected = [len(library.encode(t or "", add_special_tokens=False)) for t in texts]
    assert token_counts.TextCounter(WORDS).count(texts).tolist() == expected


def test_ids_equal_the_library():
    texts = [*random_texts(3000), None, "", " "]
    library = Tokenizer.from_file(BYTES)
    found = list(TextEncoder(BYTES).encode(texts, 7))
    assert [i for i, _ in found] == list(range(len(texts)))
    assert [x.tolist() for _, x in found] == [library.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 40)
    texts = ["one two three " * 40, "x" * 300, "don't  stop\n\n now " * 30, None, "a"]
    library = Tokenizer.from_file(BYTES)
    found = [x.tolist() for _, x in TextEncoder(BYTES).encode(texts, 0)]
    assert found == [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_a_full_cache_starts_anew():
    encoder = TextEncoder(BYTES)
    encoder.cache.most = 5
    library = Tokenizer.from_file(BYTES)
    for text in random_texts(50, seed=2):
        assert next(encoder.encode([text], 0))[1].tolist() == library.encode(text, add_special_tokens=False).ids + [0]


def test_count_query(spark, documents, edge_rows):
    docs = documents([*edge_rows, (7, "token " * 3000)])
    found = token_counts.count_tokens(docs, WORDS).collect()
    library = Tokenizer.from_file(WORDS)
    expected = Counter()
    for i, t in [*edge_rows, (7, "token " * 3000)]:
        n = len(library.encode(t or "", add_special_tokens=False))
        expected[i, len((t or "").encode()), n, n > 2048] += 1
    assert Counter(map(tuple, found)) == expected
    assert token_counts.count_tokens(documents([]), WORDS).count() == 0


def _ids(text, end):
    return Tokenizer.from_file(BYTES).encode(text or "", add_special_tokens=False).ids + [end]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, documents, staged, edge_rows, tmp_path):
    rows = [*edge_rows, *((i, f"text {i} " * (i % 7)) for i in range(10, 60))]
    path = str(tmp_path / "tokens")
    token_files.write_token_files(documents(rows), BYTES, path)
    tokens = token_files.read_token_files(spark, path)
    assert Counter((r.doc_id, tuple(r.ids)) for r in tokens.collect()) == Counter((i, tuple(_ids(t, 0))) for i, t in rows)
    found = token_files.token_file_index(tokens, staged).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((i, len(_ids(t, 0)), _crc(_ids(t, 0))) for i, t in rows)


def test_token_files_are_sorted_and_pruned(spark, documents, tmp_path):
    path = tmp_path / "tokens"
    token_files.write_token_files(documents([(i, f"t {i}") for i in range(200)]), BYTES, str(path))
    ranges = []
    for file in path.glob("*.orc"):
        ids = orc.ORCFile(file).read(columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids)
        ranges.append((ids[0], ids[-1]))
    ranges.sort()
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    one = token_files.read_token_files(spark, str(path)).filter("doc_id = 77")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in one._jdf.queryExecution().toString()
    assert [r.doc_id for r in one.collect()] == [77]


def test_empty_token_files(spark, documents, staged, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_token_files(documents([]), BYTES, path)
    assert token_files.read_token_files(spark, path).count() == 0


@pytest.mark.parametrize("sizes", [(20, 1024), (2000, 1024), (500, 300), (2000, 90), (1, 5)])
def test_packing_plan(sizes):
    n, most = sizes
    rng = random.Random(n)
    counts = Counter(min(most, max(1, int(rng.lognormvariate(5, 1)))) for _ in range(n))
    plan = packing.packing_plan(dict(counts), 1024)
    used = Counter()
    for pattern, times in plan:
        assert times > 0 and sum(pattern) <= 1024
        for length in pattern:
            used[length] += times
    assert used == counts
    least = -(-sum(k * v for k, v in counts.items()) // 1024)
    assert sum(t for _, t in plan) <= max(least * 1.03, least + 2)


def test_exact_fills_of_two_three_and_four():
    assert packing.packing_plan({600: 2, 424: 2}, 1024) == [((600, 424), 2)]
    assert packing.packing_plan({600: 1, 300: 1, 124: 1}, 1024) == [((600, 300, 124), 1)]
    assert packing.packing_plan({500: 1, 300: 1, 200: 1, 24: 1}, 1024) == [((500, 300, 200, 24), 1)]
    assert packing.packing_plan({512: 3}, 1024) == [((512, 512), 1), ((512,), 1)]
    assert packing.packing_plan({1024: 4}, 1024) == [((1024,), 4)]


def test_packed_pieces(spark, documents, staged, edge_rows):
    rows = [*edge_rows, *((i, "word " * (i * 37 % 900)) for i in range(10, 90)), (99, "long " * 5000)]
    pieces_ = staged(packing.token_pieces(documents(rows), BYTES, with_ids=True), "pieces")
    placed = packing.pack(pieces_).collect()
    by_doc = Counter()
    for r in placed:
        ids = list(r.ids)
        assert r.length == len(ids) <= 1024 and r.ids_crc32 == _crc(ids)
        by_doc[r.doc_id] += r.length
    expected = Counter()
    for i, t in rows:
        expected[i] += len(_ids(t, 2))
    assert by_doc == expected
    sequences = {}
    for r in placed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    long = sorted((r.piece, r.start, r.length) for r in placed if r.doc_id == 99)
    n = len(_ids("long " * 5000, 2))
    assert [p for p, _, _ in long] == list(range(-(-n // 1024)))
    assert [x for _, _, x in long[1:]] == [1024] * (len(long) - 1)
    joined = packing.sequences(packing.pack(pieces_)).collect()
    assert sum(len(r.ids) for r in joined) == sum(expected.values()) and max(len(r.ids) for r in joined) <= 1024


def test_packing_nothing(spark, documents, staged):
    assert packing.pack(staged(packing.token_pieces(documents([]), BYTES), "pieces")).count() == 0


def test_pieces_are_told_apart_and_found_again(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    texts = [" ".join(words[i : i + 200]) for i in range(0, len(words), 200)]
    encoder = TextEncoder(BYTES)
    found = [x.tolist() for _, x in encoder.encode(texts, 0)]
    library = Tokenizer.from_file(BYTES)
    assert found == [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    distinct = {(" " if i % 200 else "") + w for i, w in enumerate(words)}
    assert encoder.cache.held == len(distinct) <= len(encoder.cache.slots) // 2
    monkeypatch.setattr(encoder.cache, "values", None)  # nothing is encoded twice
    assert [x.tolist() for _, x in encoder.encode(texts, 0)] == found
