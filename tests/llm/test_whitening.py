"""Whitening against a dense eigenvalue decomposition."""

import math

import numpy as np
import pytest

from sellerscope.llm.whitening import LEAST, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, component int"


@pytest.fixture
def vectors(spark):
    def build(rows):
        return spark.createDataFrame([(i, v, 0, -1) for i, v in rows], SCHEMA).repartition(3)

    return build


def dense(rows, wanted=16):
    x = np.array([np.floor(64 * np.array(v, np.float32).astype(float)) for _, v in rows]).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    there = np.sqrt(np.maximum(values[:wanted], 0)) > 1e-6
    values, vectors = values[:wanted][there], vectors[:, :wanted][:, there]
    return n, ((n * x - s) ** 2).sum(axis=1), (n * x - s) / n @ vectors / np.sqrt(values), values


def check(found, rows, trace_of):
    n, deviation, whitened, values = dense(rows)
    k = len(values)
    assert len(found) == k * len(rows)
    by = {}
    for r in found:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    ids = [i for i, _ in rows]
    got = np.array([[by[i, c + 1][0]["whitened"] for c in range(k)] for i in ids])
    sign = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got * sign - whitened).max() < 1e-8
    assert [by[i, 1][0]["deviation"] for i in ids] == deviation.tolist()
    assert {r["n"] for r in found} == {n}
    errors = {r["identity_error"] for r in found}
    assert len(errors) == 1 and errors.pop() < 1e-8
    shares = [by[ids[0], c + 1][0]["explained"] for c in range(k)]
    assert shares == pytest.approx((values / trace_of).tolist(), rel=1e-10)
    assert shares == sorted(shares, reverse=True)


def trace(rows):
    x = np.unique(np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)), axis=0)
    return x.var(axis=0).sum()


def test_equals_dense_decomposition(vectors, staged):
    rng = np.random.default_rng(1)
    values = rng.normal(size=(300, 24)) * np.linspace(0.1, 3, 24)
    rows = list(enumerate(values.tolist()))
    rows += [(1000 + i, rows[i][1]) for i in range(40)]  # copies count once in the fit
    left_out = [(2000, None), (2001, [float("nan")] + [0.0] * 23), (2002, [math.inf] * 24), (2003, [None] + [1.0] * 23), (2004, []), (2005, [1.0, 2.0])]
    found = whiten(vectors(rows + left_out), staged).collect()
    check(found, rows, trace(rows))


def test_fewer_components_than_dimensions(vectors, staged):
    """Vectors in a plane of a space of five dimensions."""
    rng = np.random.default_rng(2)
    rows = [(i, [a, b, a, 0.5, b]) for i, (a, b) in enumerate((rng.integers(-9, 9, (60, 2)) / 4).tolist())]
    found = whiten(vectors(rows), staged).collect()
    check(found, rows, trace(rows))
    assert {r["component"] for r in found} == {1, 2}


def test_equal_deviations(vectors, staged):
    """A cross: all eigenvalues are equal, so any basis will do, but it has to whiten."""
    rows = [(2 * i + j, [float(s if d == i else 0) for d in range(6)]) for i in range(6) for j, s in enumerate((1, -1))]
    found = whiten(vectors(rows), staged, components=6).collect()
    assert len(found) == 72 and max(r["identity_error"] for r in found) < 1e-10
    assert {round(r["explained"], 10) for r in found} == {round(1 / 6, 10)}


def test_unlike_scales(vectors, staged):
    rng = np.random.default_rng(3)
    rows = list(enumerate((rng.normal(size=(200, 4)) * [1e5, 1.0, 1e-1, 30.0]).tolist()))
    assert LEAST < 1e-6
    found = whiten(vectors(rows), staged).collect()
    assert max(r["identity_error"] for r in found) < 1e-4 and len(found) == 800


def test_nothing_to_whiten(vectors, staged):
    assert whiten(vectors([]), staged).collect() == []
    assert whiten(vectors([(1, None), (2, [])]), staged).collect() == []
    assert whiten(vectors([(1, [1.0, 2.0]), (2, [1.0, 2.0])]), staged).collect() == []


def test_rows_without_an_id(vectors, staged):
    found = whiten(vectors([(None, [0.0, 1.0]), (7, [1.0, 0.0]), (7, [0.0, 3.0])]), staged).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in found) == [("7", 1)] * 2 + [("7", 2)] * 2 + [("None", 1), ("None", 2)]
