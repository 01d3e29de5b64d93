"""The corpus pipeline against plain Python, stage by stage, and its rows end to end."""

import re
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(f"w{w}" for w in rng.integers(0, 4000, n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(21)
    texts = [sentence(rng, 60) for _ in range(30)]
    passage = sentence(rng, 14)
    copy = texts[3].split()
    copy[30] = "changed"
    texts += [texts[3], " ".join(copy), texts[4] + " end", sentence(rng, 5), "word " * 50, None, "", " \n "]
    texts += [sentence(rng, 40) + " " + passage + " " + sentence(rng, 30), sentence(rng, 30) + f" password: hunter2hunter2 {sentence(rng, 25)}"]
    texts += [sentence(rng, 2500)]
    out = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return out + [out[7], (out[8][0], texts[9], "de", "s", 1), (None, sentence(rng, 40), "en", None, None)], passage


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows[0], DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, rows[1]), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def keyed(docs):
    return Counter((r["doc_id"], r["text"]) for r in docs.collect())


def good(text):
    """The base rules; too few labels for any cutoff."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words) >= 20 and 100 * len(repeated) <= 30 * len(words)


def test_stages(spark, rows, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "packing"]

    kept = stages["quality_rules"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    expected = Counter((i, t) for i, t, *_ in rows[0] if good(t))
    assert keyed(kept) == expected

    unique = stages["near_duplicates"](spark, kept, sf_dir)
    assert unique.columns == docs.columns
    texts = defaultdict(list)
    for i, t in expected:
        texts[i].append(t)
    none = texts.pop(None)
    one_text = {i: min(t) for i, t in texts.items()}
    found = keyed(unique)
    assert {i for i, _ in found if i is not None} == {i for i, (_, c) in brute.near_duplicates([(i, t) for i, t in one_text.items()]).items() if i == c}
    assert all(t == (one_text[i] if i is not None else none[0]) and n == 1 for (i, t), n in found.items())

    clean = stages["decontamination"](spark, unique, sf_dir)
    assert clean.columns == docs.columns
    assert keyed(clean) == Counter({k: n for k, n in found.items() if rows[1] not in k[1]})

    masked = stages["secret_scan"](spark, clean, sf_dir)
    assert masked.columns == docs.columns
    changed = keyed(clean) - keyed(masked)
    assert ["hunter2" in t for _, t in changed] == [True] and not any("hunter2" in t for _, t in keyed(masked))

    pieces = stages["packing"](spark, masked, sf_dir).collect()
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = Counter(p["doc_id"] for p in pieces)
    assert set(lengths) == {i for i, _ in keyed(masked)}
    total = sum(len(tokens.encode(t, add_special_tokens=False).ids) + 1 for _, t in keyed(masked).elements())
    assert sum(p["length"] for p in pieces) == total
    check_sequences(pieces)


def check_sequences(pieces):
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for places in by_sequence.values():
        ends = np.cumsum([0] + [n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= 1024


def test_run_applies_all_stages(spark, rows, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, sf_dir)
    figures = lambda frame: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in frame.collect())
    found = corpus_pipeline.run(spark, sf_dir)
    assert figures(found) == figures(docs)
    check_sequences(found.collect())


def test_empty_tables(spark, sf_dir, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
