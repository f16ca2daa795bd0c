"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Entries become integers ``x = floor(scale * c) + offset``.  The scatter is exact:
every x is centred at the rounded mean of its dimension before anything is
multiplied, and what the rounding left is taken off in whole numbers.  On the
driver the d x d covariance V is factored with diagonal pivoting, ``V = L L'``;
rotations make the columns of L orthogonal, and then their squared norms are the
eigenvalues of V and the normalised columns its eigenvectors.

Defined cases: rows whose vector is null, empty, of another length than most, or
holds a null or non-finite entry are dropped.  Repeated rows count as often as they
occur and get equal results.  A direction without variance is no component: with
rank r below ``components`` there are r, and none where all vectors agree.  No rows:
no output.  Null ids are kept.  Other columns are ignored.  A deviation that does
not fit a long is null.

Moves: per task d(d+1)/2 sums.  Collected: the d x d scatter (d is the vector length).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nutriyield.llm.vectors import exact_products, matrix, pieces, usable

LONG = 2.0**63


@dataclass
class Whitening:
    n: int
    shift: np.ndarray  # rounded mean of x per dimension
    rest: np.ndarray  # sum of x - shift per dimension
    components: np.ndarray  # unit eigenvectors as columns, by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float
    scale: int
    offset: int
    identity_error: float = 0.0

    def centred(self, vectors: np.ndarray) -> np.ndarray:
        """x - shift as whole numbers."""
        return np.floor(vectors * self.scale).astype(np.int64) + self.offset - self.shift

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened rows; the sums run dimension by dimension, so equal rows agree in every bit."""
        z, out = y - self.rest / self.n, np.zeros((len(y), len(self.eigenvalues)))
        basis = self.components / np.sqrt(self.eigenvalues)
        for j in range(z.shape[1]):
            out += z[:, j:j + 1] * basis[j]
        return out


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L (d x rank, rows in the order of ``v``) with v = L L'; the largest remaining diagonal entry leads each step."""
    d, left = len(v), v.astype(np.float64).copy()
    out, floor = np.zeros((d, d)), d * np.finfo(float).eps * max(float(np.diag(v).max()), 0.0) if d else 0.0
    for k in range(d):
        p = int(np.argmax(np.diag(left)))
        if left[p, p] <= floor:
            return out[:, :k]
        out[:, k] = left[:, p] / np.sqrt(left[p, p])
        left -= np.outer(out[:, k], out[:, k])
        left[p, :] = left[:, p] = 0.0
    return out


def orthogonal_columns(a: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """One-sided Jacobi: rotates pairs of columns until all are orthogonal.

    A sweep pairs every two columns once, in rounds of disjoint pairs.
    """
    a, r = a.copy(), a.shape[1]
    seats = np.arange(r + r % 2)  # an odd column out sits opposite an empty seat
    half = len(seats) // 2
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(max(len(seats) - 1, 0)):
            i, j = seats[:half], seats[half:][::-1]
            real = (i < r) & (j < r)
            i, j = i[real], j[real]
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            scale = np.sqrt(xx * yy)
            turn = np.abs(xy) > 1e-16 * scale
            worst = max(worst, float((np.abs(xy[turn]) / scale[turn]).max(initial=0.0)))
            tau = np.where(turn, (yy - xx) / np.where(turn, 2 * xy, 1.0), 0.0)
            t = np.where(turn, np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.sqrt(1 + tau * tau)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            a[:, i], a[:, j] = c * x - c * t * y, c * t * x + c * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= 1e-15:
            break
    return a


def _sums(rows: DataFrame, run) -> list[list[int]]:
    """[i, j, exact sum] over all tasks; ``run`` yields (i, j, sum) batches."""
    got = rows.select("vector").mapInArrow(run, "i int, j int, s long").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return [[r["i"], r["j"], int(r["s"])] for r in got.collect()]


def _batch(i, j, s, kind=None):
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(s, kind)], names=["i", "j", "s"])


def fit_whitening(rows: DataFrame, d: int, components: int = 32, scale: int = 64, offset: int = 1_000_000) -> Whitening:
    """Whitening fitted on all ``rows`` of ``usable``, with its measured identity error."""
    def add_up(batches):
        n, total = 0, np.zeros(d, np.int64)
        for piece in pieces(batches):
            x = np.floor(matrix(piece.column(0), d) * scale).astype(np.int64) + offset
            n += len(x)
            total += x.sum(0)
        yield _batch([-1, *range(d)], [0] * (d + 1), [n, *total.tolist()])

    sums = {i: s for i, _, s in _sums(rows, add_up)}
    n, total = sums[-1], [sums[j] for j in range(d)]
    shift = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(total, shift)], np.int64)
    model = Whitening(n, shift, rest, np.zeros((d, 0)), np.zeros(0), 0.0, scale, offset)

    def scatter(batches):
        products = np.zeros((d, d), np.int64)
        for piece in pieces(batches):
            y = model.centred(matrix(piece.column(0), d)).T.copy()
            products += exact_products(y, y)
        i, j = np.triu_indices(d)
        yield _batch(i, j, products[i, j])

    v = np.zeros((d, d))
    for i, j, s in _sums(rows, scatter):  # n V = products - rest rest' / n, in whole numbers before the division
        v[i, j] = v[j, i] = (n * s - int(rest[i]) * int(rest[j])) / (n * n)
    columns = orthogonal_columns(pivoted_cholesky(v))
    values = (columns * columns).sum(0)
    order = np.argsort(-values, kind="stable")[:components]
    model.components, model.eigenvalues = columns[:, order] / np.sqrt(values[order]), values[order]
    model.trace = float(np.trace(v))
    model.identity_error = _identity_error(rows, model, d)
    return model


def _identity_error(rows: DataFrame, model: Whitening, d: int) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, measured over all rows."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0

    def run(batches):
        mean, products = np.zeros(k), np.zeros((k, k))
        for piece in pieces(batches):
            w = model.project(model.centred(matrix(piece.column(0), d)))
            mean += w.sum(0)
            products += w.T @ w
        i, j = np.triu_indices(k)
        yield _batch(np.concatenate([np.full(k, -1), i]), np.concatenate([np.arange(k), j]), np.concatenate([mean, products[i, j]]), pa.float64())

    got = rows.select("vector").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    mean, cov = np.zeros(k), np.zeros((k, k))
    for r in got:  # components squared rows
        if r["i"] < 0:
            mean[r["j"]] = r["s"] / model.n
        else:
            cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["s"] / model.n
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening, d: int) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per row and component."""
    k, n = len(model.eigenvalues), model.n
    explained = model.eigenvalues / model.trace if k else np.zeros(0)
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for piece in pieces(batches, 2048):
            y = model.centred(matrix(piece.column("vector"), d))
            rough = ((y * float(n) - model.rest) ** 2).sum(1)
            fits = rough < LONG * (1 - 1e-9)
            apart = np.where(fits[:, None], y, 0) * np.int64(n) - np.where(fits[:, None], model.rest, 0)
            deviation = pa.array((apart * apart).sum(1), mask=~fits)
            each = pa.array(np.repeat(np.arange(len(y)), k))
            size = len(y) * k
            yield pa.RecordBatch.from_arrays([
                piece.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1), len(y)), pa.int32()), pa.array(np.full(size, n, np.int64)),
                deviation.take(each), pa.array(model.project(y).ravel()), pa.array(np.tile(explained, len(y))),
                pa.array(np.full(size, model.identity_error))], names=names)

    return rows.select("id", "vector").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten_embeddings(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32,
                      scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Fit on all usable rows of ``df`` and whiten them."""
    rows, d = usable(df, id_col, vector_col)
    if not d:
        return df.sparkSession.createDataFrame([], f"`{id_col}` {dict(rows.dtypes)['id']}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return whiten(rows, fit_whitening(rows, d, components, scale, offset), d).withColumnRenamed("id", id_col)
