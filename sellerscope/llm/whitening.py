"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers; the distinct ones, centred, are the rows of X. X stays where it is; the driver holds a few
vectors of its width. A step multiplies X by a vector and, in the same pass, Xᵀ by the product, so a pass over the
rows gives u = Xw, Xᵀu and the inner products of u with the earlier left vectors. These left vectors are as long as the
table; each is kept as the short vector w that gives it as Xw. Both sides are orthogonalised against all earlier vectors
in every step. The bidiagonal matrix that results is at most as large as the width; its singular values and right
vectors give components and deviations.

Steps end when the residuals of the wanted components are at rounding error, at the latest after as many as the width;
where the residual vector vanishes (equal deviations, vectors inside a subspace), a new direction starts.

Defined results: rows whose vector is null, holds null or non-finite entries, has no entries, or is not as long as most
vectors (the longer ones on ties) are left out. Components of no deviation (below ``LEAST`` of the largest) do not exist, so fewer
than asked for, or none, may be returned, and one distinct vector gives no rows. Repeated rows count once in the fit, and each
has its result rows. Rows without an id are treated like others. Entries are cut at ``LARGEST`` in size. ``deviation`` is
null where it exceeds a long. An empty table gives no rows. Extra columns do not take part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
LEAST = 1e-11
LARGEST = 2.0**40
_EPS = np.finfo(np.float64).eps

Staged = Callable[[DataFrame, str], DataFrame]
Batches = Iterator[pa.RecordBatch]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class _Rows:
    """The centred distinct vectors, and sums over them."""

    def __init__(self, fit: DataFrame, width: int):
        self.fit, self.width = fit, width
        places = [F.col("x")[i] for i in range(width)]
        figures = fit.agg(F.count("*"), F.max(F.greatest(*map(F.abs, places)) if width > 1 else F.abs(places[0]))).first()
        self.n, largest = figures[0], figures[1] or 0
        # plain Python numbers where 64 bits may not do
        self.kind = np.int64 if self.n * largest < 1 << 62 else object
        self.sums = np.array([0] * width, self.kind)
        if self.n:
            found = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
            for r in found.collect():  # a row for each dimension
                self.sums[r["i"]] = int(r["s"])

    def total(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of ``of`` (centred rows of a batch) over all batches."""
        centred, width = self.centred, self.width

        def run(batches: Batches) -> Batches:
            held = None
            for batch in batches:
                part = of(centred(_matrix(batch.column(0), width)[:, :]))
                held = part if held is None else held + part
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([held.tolist()], pa.list_(pa.float64()))], ["sums"])

        parts = self.fit.select("x").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("i", "v"))
        found = parts.groupBy("i").agg(F.sum("v").alias("v")).collect()  # as many rows as ``of`` has figures
        out = np.zeros(len(found))
        for r in found:
            out[r["i"]] = r["v"]
        return out

    @property
    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        n, sums, kind = self.n, self.sums, self.kind
        return lambda x: ((n * x.astype(kind) - sums) / n).astype(np.float64)


def _orthogonal(v: np.ndarray, to: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for q in to:
            v = v - (q @ v) * q
    return v


def bidiagonalised(product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]], width: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (as columns) and singular values of X, largest first.

    ``product(w, earlier)`` gives XᵀXw, the inner products of Xw with Xe for the columns e of ``earlier``, and
    the square of the length of Xw.
    """
    random = np.random.default_rng(width)
    right: list[np.ndarray] = []
    left: list[np.ndarray] = []  # short vectors w, u = Xw
    turned: list[np.ndarray] = []  # XᵀXw
    alphas: list[float] = []
    betas: list[float] = []
    scale = 0.0
    v = random.standard_normal(width)
    v /= np.linalg.norm(v)
    beta = 0.0
    while True:
        right.append(v)
        w = v - beta * left[-1] if left else v
        for _ in range(3):
            earlier = np.array(left).T if left else np.zeros((width, 0))
            g, inner, square = product(w, earlier)
            if left:
                w = w - earlier @ inner
                g = g - np.array(turned).T @ inner
            less = square - inner @ inner
            if less > 0.5 * square or square == 0:
                break
        alpha = float(np.sqrt(max(less, 0.0)))
        scale = max(scale, alpha, beta)
        if alpha <= width * _EPS * scale or scale == 0:
            alpha, w, g = 0.0, np.zeros(width), np.zeros(width)
        else:
            w, g = w / alpha, g / alpha
        alphas.append(alpha)
        left.append(w)
        turned.append(g)
        k = len(right)
        following = _orthogonal(g - alpha * v, right)
        beta = float(np.linalg.norm(following))
        if beta <= width * _EPS * scale:
            beta = 0.0
            following = _orthogonal(random.standard_normal(width), right)
        matrix = np.diag(alphas) + np.diag(betas, 1)
        p, values, q = np.linalg.svd(matrix)
        residual = beta * np.abs(p[-1, :wanted])
        if k == width or (beta and k > wanted and residual.max() <= _EPS * values[0]):
            return np.array(right).T @ q.T, values
        betas.append(beta)
        v = following / np.linalg.norm(following)


class Whitening:
    """Components of the distinct vectors of a table."""

    def __init__(self, rows: _Rows, wanted: int):
        def product(w: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
            found = rows.total(lambda y: (lambda u: np.concatenate([u @ y, u @ (y @ earlier), [u @ u]]))(y @ w))
            return found[: rows.width], found[rows.width : -1], float(found[-1])

        vectors, values = bidiagonalised(product, rows.width, wanted)
        there = values[:wanted] > LEAST * max(values[0], np.finfo(float).tiny)
        self.values = values[:wanted][there] ** 2 / rows.n
        vectors = vectors[:, :wanted][:, there]
        self.components = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
        self.turn = self.components / np.sqrt(self.values)
        turn, k = self.turn, len(self.values)
        figures = rows.total(lambda y: np.concatenate([[np.square(y).sum()], (lambda z: z.T @ z)(y @ turn).ravel()]))
        self.explained = self.values / (figures[0] / rows.n)
        self.identity_error = float(np.abs(figures[1:].reshape(k, k) / rows.n - np.eye(k)).max(initial=0.0))


def _applied(rows: _Rows, found: Whitening):
    turn, explained, error, n, width = found.turn, found.explained, found.identity_error, rows.n, rows.width
    k, centred, sums, kind = len(found.values), rows.centred, rows.sums, rows.kind

    def deviations(x: np.ndarray) -> list[int | None]:
        off = n * x.astype(kind) - sums
        if kind is np.int64 and int(np.abs(off).max(initial=0)) ** 2 * width < 1 << 63:
            return np.square(off).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in off]
        return [v if v < 1 << 63 else None for v in exact]

    def run(batches: Batches) -> Batches:
        for batch in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            x = _matrix(batch.column(1), width)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [
                batch.column(0).take(at),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), n, np.int64)),
                pa.array(deviations(x), pa.int64()).take(at),
                pa.array((centred(x) @ turn).ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(at), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whole_numbers(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, x) of the rows whose vectors can be used, of any length."""
    entry = lambda c: F.floor(F.greatest(F.least(c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST)) * SCALE).cast("bigint") + SHIFT
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("v")).filter("v IS NOT NULL AND size(v) > 0")
    return rows.filter(finite).select("vec_id", F.transform("v", entry).alias("x"))


def whiten(vectors: DataFrame, staged: Staged, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """A row for each vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    rows = whole_numbers(vectors, id_column, vector_column)
    common = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.filter(F.size("x") == common["width"])
    fit = _Rows(staged(rows.select("x").distinct(), "distinct-vectors"), common["width"])
    return rows.mapInArrow(_applied(fit, Whitening(fit, min(components, common["width"]))), schema)
