"""Whitening of embeddings: distributed centred covariance, own eigensolver, broadcast projection.

1. One pass over the vectors sums every dimension exactly, in whole numbers.
2. A second pass centres each vector before it multiplies; each task adds up one matrix, and the
   tasks' matrices are summed by entry. What reaches the driver is one dim x dim matrix.
3. Householder reflections make that matrix tridiagonal, Sturm counts bisect for the leading
   eigenvalues, and inverse iteration finds their vectors, kept orthogonal within clusters of close
   eigenvalues. The reflections carry them back.
4. Mean and components, dim x k numbers, go with the tasks that project; a last pass measures the
   covariance of what they return.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
# An eigenvalue below this share of the largest one cannot be told from zero.
RANK = 1e-10
_FITS = 2.0 ** 62
_EPS = np.finfo(float).eps


# --- eigenvalues of a symmetric matrix ----------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of a symmetric matrix; reflector k acts from row k + 1."""
    a = np.array(matrix, float)
    n = len(a)
    off, reflectors = np.zeros(max(n - 1, 0)), []
    for k in range(n - 1):
        v = a[k + 1:, k].copy()
        length = np.linalg.norm(v)
        off[k] = -np.copysign(length, v[0])
        v[0] -= off[k]
        size = np.linalg.norm(v)
        if size > 0:
            v /= size
            block = a[k + 1:, k + 1:]
            p = block @ v
            w = p - (v @ p) * v
            block -= 2 * (np.outer(v, w) + np.outer(w, v))
        reflectors.append(v)
    return np.diag(a).copy(), off, reflectors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: negative pivots of T - x I (Sturm)."""
    tiny = np.finfo(float).tiny
    count = np.zeros(len(at), np.int64)
    pivot = np.ones(len(at))
    for i, d in enumerate(diagonal):
        pivot = d - at - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny / _EPS, -tiny / _EPS, pivot)
        count += pivot < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until its bracket cannot be halved."""
    n = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    slack = 4 * _EPS * max(abs(low), abs(high)) + np.finfo(float).tiny
    lows, highs = np.full(k, low - slack), np.full(k, high + slack)
    # The j-th largest has n - j eigenvalues below it.
    wanted = n - np.arange(1, k + 1)
    while True:
        middle = (lows + highs) / 2
        if not ((middle > lows) & (middle < highs) & (highs - lows > 2 * _EPS * np.abs(middle))).any():
            return middle
        left = below(diagonal, off, middle) > wanted
        lows, highs = np.where(left, lows, middle), np.where(left, middle, highs)


def _solve(diagonal: np.ndarray, off: np.ndarray, right: np.ndarray, tiny: float) -> np.ndarray:
    """x of a tridiagonal system, by elimination with row exchanges; tiny pivots are made ``tiny``."""
    n = len(diagonal)
    d, e, b = diagonal.tolist(), [*off.tolist(), 0.0], right.tolist()
    # A row holds its entries from the diagonal on; a row exchange brings in a third one.
    rows, here = [], [d[0], e[0], 0.0]
    for i in range(n - 1):
        under = [e[i], d[i + 1], e[i + 1]]
        if abs(under[0]) > abs(here[0]):
            here, under = under, here
            b[i], b[i + 1] = b[i + 1], b[i]
        if abs(here[0]) < tiny:
            here[0] = tiny
        factor = under[0] / here[0]
        rows.append(here)
        here = [under[1] - factor * here[1], under[2] - factor * here[2], 0.0]
        b[i + 1] -= factor * b[i]
    rows.append(here if abs(here[0]) >= tiny else [tiny, 0.0, 0.0])
    x = [0.0] * (n + 2)
    for i in range(n - 1, -1, -1):
        x[i] = (b[i] - rows[i][1] * x[i + 1] - rows[i][2] * x[i + 2]) / rows[i][0]
    return np.array(x[:n])


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, one a row, for falling eigenvalues of a tridiagonal matrix.

    Values closer than a thousandth of the matrix's norm form a cluster; inside it each vector is
    kept orthogonal to the ones before it, in every step of its iteration.
    """
    n = len(diagonal)
    norm = float((np.abs(diagonal) + np.abs(np.append(off, 0)) + np.abs(np.append(0, off))).max())
    tiny = max(_EPS * norm, np.finfo(float).tiny)
    draw = np.random.default_rng(11)
    found = np.zeros((len(values), n))
    start = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            start = k
        # Equal values would solve the same system; a few roundings set them apart.
        shifted = value - (k - start) * 2 * tiny
        x = draw.standard_normal(n)
        for _ in range(8):
            for _ in range(2):
                x = x - found[start:k].T @ (found[start:k] @ x)
            x = _solve(diagonal - shifted, off, x / np.linalg.norm(x), tiny)
            x /= np.abs(x).max()
        for _ in range(2):
            x = x - found[start:k].T @ (found[start:k] @ x)
            x /= np.linalg.norm(x)
        found[k] = x
    return found


def principal(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit vectors as rows) of the at most k leading ones that are not zero."""
    n = len(matrix)
    scale = np.abs(matrix).max(initial=0)
    if not scale > 0:
        return np.zeros(0), np.zeros((0, n))
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = leading(diagonal, off, min(k, n))
    values = values[values > RANK * values[0]]
    rows = vectors_of(diagonal, off, values)
    for at in range(len(reflectors) - 1, -1, -1):
        v = reflectors[at]
        rows[:, at + 1:] -= 2 * np.outer(rows[:, at + 1:] @ v, v)
    return values * scale, rows / np.linalg.norm(rows, axis=1, keepdims=True)


# --- passes over the vectors ---------------------------------------------------------------------


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def whole(vectors: np.ndarray) -> np.ndarray:
    """x = floor(64 c) + 1000000 of every entry."""
    return np.floor(SCALE * vectors).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: in 64 bits where that fits, else as Python's whole numbers."""
    most = max(float(np.abs(x).max(initial=0)) * n, max(map(abs, sums)))
    if 2 * most < _FITS:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(spread: np.ndarray) -> list[int]:
    """Sum of squares of each row, exact."""
    most = float(np.abs(spread).max(initial=0))
    if most * most * spread.shape[1] < _FITS:
        return (spread * spread).sum(1).tolist()
    exact = spread.astype(object)
    return (exact * exact).sum(1).tolist()


def _summed(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            x = whole(_matrix(batch.column(0), dim))
            n += len(x)
            fits = float(np.abs(x).max(initial=0)) * len(x) < _FITS
            part = x.sum(0) if fits else x.astype(object).sum(0)
            total = [a + int(b) for a, b in zip(total, part)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *range(dim)], pa.int32()), pa.array([n, *total], pa.decimal128(38, 0))],
                names=["i", "total"],
            )

    parts = rows.select("embedding").mapInArrow(run, "i int, total decimal(38,0)")
    # dim + 1 rows.
    found = {r["i"]: int(r["total"]) for r in parts.groupBy("i").agg(F.sum("total").alias("total")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dim)]


def covariance(rows: DataFrame, dim: int, points: Callable[[np.ndarray], np.ndarray], size: int, n: int) -> np.ndarray:
    """Mean outer product of ``points(vectors)``, which must be centred; ``size`` numbers each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = points(_matrix(batch.column(0), dim))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, size * size + 1, size), pa.int32()), pa.array(total.ravel())
            )
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), lists], names=["i", "line"])

    parts = rows.select("embedding").mapInArrow(run, "i int, line array<double>")
    entries = parts.select("i", F.posexplode("line").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    # size * size rows, whatever the number of vectors.
    for r in entries.collect():
        out[r["i"], r["j"]] = r["v"] / n
    return (out + out.T) / 2


@dataclass
class Whitening:
    """What a fit found: counts, exact sums, eigenvalues, components (one a row)."""

    dim: int
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray
    identity_error: float = 0.0

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if len(self.values) else self.values

    def points(self, vectors: np.ndarray) -> np.ndarray:
        """x - S / n of every vector, from the exact n x - S."""
        return centred(whole(vectors), self.n, self.sums).astype(float) / self.n

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return self.points(vectors) @ (self.components / np.sqrt(self.values)[:, None]).T


def usable(vectors: DataFrame, dim: int | None = None) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the rows that take part, and their length."""
    number = F.col("embedding")
    limit = _FITS / SCALE / 2
    rows = vectors.select("vec_id", number.cast("array<double>").alias("embedding")).where(
        (F.size("embedding") > 0)
        & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < limit))
    )
    if dim is None:
        most = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
        dim = most["dim"] if most else 0
    return rows.where(F.size("embedding") == dim), dim


def fit(vectors: DataFrame, components: int = COMPONENTS, dim: int | None = None) -> Whitening:
    """Fit to all rows of (embedding); see ``whiten`` for the rows that take part."""
    rows, dim = usable(vectors, dim)
    n, sums = _summed(rows, dim) if dim else (0, [])
    model = Whitening(dim, n, sums, 0.0, np.zeros(0), np.zeros((0, dim)))
    if not n:
        return model
    matrix = covariance(rows, dim, model.points, dim, n)
    model.trace = float(np.trace(matrix))
    model.values, model.components = principal(matrix, components)
    if len(model.values):
        k = len(model.values)
        model.identity_error = float(np.abs(covariance(rows, dim, model.project, k, n) - np.eye(k)).max())
    return model


def whiten(vectors: DataFrame, model: Whitening | None = None) -> DataFrame:
    """(vec_id, n, deviation, whitened): one row per usable row of (vec_id, embedding).

    Rows whose vector is null, empty, holds null or non-finite entries, or entries of which 64
    times does not fit a whole number of 61 bits, are left out, and so are vectors that have not
    the length most vectors have (ties: the longer). Repeated rows count as often as they stand
    there; a null vec_id stays null; other columns are ignored. ``deviation`` is exact, as
    decimal(38,0). Components with no variance are left out: equal vectors, a single one or none
    give empty lists. No row gives no row.
    """
    model = fit(vectors) if model is None else model
    rows, dim = usable(vectors, model.dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            spread = centred(whole(x), model.n, model.sums)
            out = model.project(x)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([model.n] * len(x), pa.int64()),
                 pa.array(deviations(spread), pa.decimal128(38, 0)), lists],
                names=["vec_id", "n", "deviation", "whitened"],
            )

    kind = dict(rows.dtypes)["vec_id"]
    return rows.mapInArrow(run, f"vec_id {kind}, n bigint, deviation decimal(38,0), whitened array<double>")
