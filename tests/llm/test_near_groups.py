"""Near duplicates in groups whose copies are mostly too unlike each other."""

import brute
import numpy as np
import pytest

from sellerscope.llm import near_duplicates as nd


def group(rng, words, size, most):
    """Copies of one text, each with up to ``most`` words changed, so that some are linked and most pairs are not."""
    base = rng.integers(0, 2000, words)
    out = []
    for _ in range(size):
        copy = base.copy()
        at = rng.choice(words, int(rng.integers(1, most)), replace=False)
        copy[at] = rng.integers(2000, 9000, len(at))
        out.append(" ".join(f"w{w}" for w in copy))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    texts = group(rng, 150, 260, 14) + group(rng, 700, 60, 60)
    texts += [" ".join(f"x{w}" for w in rng.integers(0, 500, rng.integers(1, 60))) for _ in range(60)]
    return list(enumerate(texts))


def test_every_link_of_unlike_copies_is_found(documents, staged, rows):
    expected = brute.near_duplicates(rows)
    found = nd.near_duplicates(documents(rows), staged).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected
    assert 30 < len({c for _, c in expected.values()}) < 300


def test_pairs_leave_blocks_only_if_they_may_be_links(documents, rows):
    """The group's pairs are nearly all close by signature; only links, and a few near ones, get to the texts."""
    from sellerscope.session import stage

    sizes = {}

    def counted(df, label):
        out = stage(df, label)
        sizes.setdefault(label, []).append(out.count())
        return out

    nd.near_duplicates(documents(rows), counted).collect()
    sets = [brute.shingles(t) for _, t in rows]
    links = sum(100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b)
    assert sum(sizes["close-pairs"]) < links / 2


def test_samples_compare_whole_sets_exactly():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)) for n in (40, 200, 256)]
    sets += [np.sort(np.concatenate([sets[1][:190], sets[0][:k]])) for k in (10, 30, 40)]
    sizes = np.array([len(s) for s in sets])
    samples = nd._Samples([(s[: nd.SAMPLE] >> np.uint64(32)).astype("<u4").tobytes() for s in sets], sizes)
    for i, a in enumerate(sets):
        shared = np.array([len(np.intersect1d(a, b)) for b in sets])
        exact = 100 * (shared + 1) >= 75 * (len(a) + sizes - shared - 1)
        assert samples.similar(i, samples, np.arange(len(sets))).tolist() == exact.tolist()


def test_samples_of_long_sets_keep_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 4000, np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([base[:n], rng.integers(0, 1 << 63, 4000 - n, np.uint64) * np.uint64(2)])) for n in [3450] * 40 + [1000] * 10]
    samples = nd._Samples([(s[: nd.SAMPLE] >> np.uint64(32)).astype("<u4").tobytes() for s in sets], np.array([len(s) for s in sets]))
    for i in range(40):
        kept = samples.similar(i, samples, np.arange(50))
        similar = [100 * len(np.intersect1d(sets[i], s)) >= 75 * len(np.union1d(sets[i], s)) for s in sets]
        assert not (np.array(similar) & ~kept).any() and not kept[40:].any()


def test_one_row_of_a_shared_id(spark, staged):
    """Rows of one id with different texts: always the same row stays."""
    rows = [(1, "b b", {"k": 1}), (1, "a a", {"k": 2}), (1, "a a", {"k": 1}), (2, "c", None), (None, "d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>").repartition(4)
    kept = nd.first_of_each_group(docs, staged).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, "a a", {"k": 1}), (2, "c", None), (None, "d", None)], key=str)
