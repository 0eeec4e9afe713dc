"""Whitening of embeddings: every vector in units of the leading principal components.

Spark sums the distinct vectors and then their centred products (each task adds
up its rows and hands on one row per entry of the matrix); the driver sees one
number per dimension and one per entry of the covariance, whatever the table
holds. There Householder reflections make it tridiagonal, Sturm counts bisect
for the leading eigenvalues, and inverse iteration, with vectors of close
eigenvalues orthogonalised against each other, gives the components. Every
row is then projected where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import Scratch

EPS = np.finfo(float).eps
#: Eigenvalues nearer than this share of the norm are orthogonalised against each other.
CLUSTER = 1e-3


# ---- symmetric eigenproblem of one small matrix ----------------------------------------------------------------
def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the Householder vectors of the reflections that lead there."""
    a = np.array(a, float)
    n = len(a)
    off, vectors = np.zeros(max(n - 1, 0)), []
    for k in range(n - 1):
        x = a[k + 1:, k].copy()
        size = float(np.linalg.norm(x))
        off[k] = x[0]
        v = np.zeros(len(x))
        if len(x) > 1 and np.abs(x[1:]).max() > 0:
            off[k] = -np.copysign(size, x[0])
            v = x
            v[0] -= off[k]
            v /= np.linalg.norm(v)
            rest = a[k + 1:, k + 1:]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        vectors.append(v)
    return np.diagonal(a).copy(), off, vectors


def sturm_count(diag: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each ``x``: the negative pivots of T - x."""
    tiny = np.finfo(float).tiny ** 0.5
    q = diag[0] - x
    below = (q < 0).astype(int)
    for k in range(1, len(diag)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = diag[k] - x - off[k - 1] ** 2 / q
        below += q < 0
    return below


def leading_values(diag: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` greatest eigenvalues, greatest first, by bisection."""
    n = len(diag)
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    rank = n - 1 - np.arange(min(count, n))  # so many eigenvalues are smaller
    lo, hi = np.full(len(rank), (diag - reach).min()), np.full(len(rank), (diag + reach).max())
    pad = EPS * max(1e-300, np.abs([lo[0], hi[0]]).max()) * n
    lo, hi = lo - pad, hi + pad
    for _ in range(200):
        mid = (lo + hi) / 2
        if ((mid <= lo) | (mid >= hi)).all():
            break
        above = sturm_count(diag, off, mid) <= rank
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return (lo + hi) / 2


def _solver(diag: np.ndarray, off: np.ndarray, shift: float, small: float):
    """Solves (T - shift) z = b by elimination with row exchanges; pivots of zero become ``small``."""
    n = len(diag)
    u0, u1, u2 = diag - shift, np.append(off, 0.0), np.zeros(n)
    factor, swapped = np.zeros(n), np.zeros(n, bool)
    for k in range(n - 1):
        low = off[k]
        if abs(low) > abs(u0[k]):
            swapped[k] = True
            factor[k] = u0[k] / low
            u0[k], u1[k], u2[k], u0[k + 1], u1[k + 1] = (low, u0[k + 1], u1[k + 1], u1[k] - factor[k] * u0[k + 1], -factor[k] * u1[k + 1])
        else:
            u0[k] = u0[k] if abs(u0[k]) > small else small
            factor[k] = low / u0[k]
            u0[k + 1] -= factor[k] * u1[k]
    u0[-1] = u0[-1] if abs(u0[-1]) > small else small

    def solve(b: np.ndarray) -> np.ndarray:
        z = b.copy()
        for k in range(n - 1):
            if swapped[k]:
                z[k], z[k + 1] = z[k + 1], z[k]
            z[k + 1] -= factor[k] * z[k]
        for k in range(n - 1, -1, -1):
            z[k] -= (u1[k] * z[k + 1] if k + 1 < n else 0) + (u2[k] * z[k + 2] if k + 2 < n else 0)
            z[k] /= u0[k]
        return z
    return solve


def leading_vectors(diag: np.ndarray, off: np.ndarray, values: np.ndarray, vectors: list[np.ndarray]) -> np.ndarray:
    """Unit eigenvectors (rows) of the matrix before the reflections, by inverse iteration."""
    norm = max(np.abs(diag).max(initial=0), np.abs(off).max(initial=0), 1e-300)
    rng = np.random.Generator(np.random.PCG64(5))
    out: list[np.ndarray] = []
    first = 0  # of the cluster
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        solve = _solver(diag, off, value - (k - first) * EPS * norm, EPS * norm)
        z = rng.standard_normal(len(diag))
        for _ in range(6):
            z /= np.abs(z).max()
            z = solve(z)
            z /= np.linalg.norm(z)
            for _ in range(2):
                for o in out[first:k]:
                    z -= (o @ z) * o
            z /= np.linalg.norm(z)
        out.append(z)
    full = []
    for z in out:
        z = z.copy()
        for k in range(len(vectors) - 1, -1, -1):
            z[k + 1:] -= 2 * vectors[k] * (vectors[k] @ z[k + 1:])
        z /= np.linalg.norm(z)
        full.append(z * np.copysign(1.0, z[np.abs(z).argmax()]))
    return np.array(full).reshape(len(full), len(diag))


def leading_components(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of a symmetric matrix that are not zero to rounding, and their unit vectors as rows."""
    if not len(v) or np.trace(v) <= 0:
        return np.zeros(0), np.zeros((0, len(v)))
    diag, off, vectors = tridiagonal(v)
    values = leading_values(diag, off, count)
    rows = leading_vectors(diag, off, values, vectors)
    values = np.einsum("ki,ij,kj->k", rows, v, rows)
    keep = values > len(v) * EPS * np.trace(v)
    return values[keep], rows[keep]


# ---- the table --------------------------------------------------------------------------------------------------
@dataclass
class Whitening:
    """What a projection needs: bounded by the dimensions of a vector."""
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray
    identity_error: float


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * c) of every entry, or null where the vector or an entry is null or not finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c)))


def _matrices(batches) -> Iterator[np.ndarray]:
    for b in batches:
        if b.num_rows:
            yield b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)


def _sums(batches):
    total = None
    for x in _matrices(batches):
        part = np.append(x.sum(0), len(x))
        total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "v"])


def _products(move):
    """Upper triangle of the sum of outer products of ``move(x)``, and its plain sums (j = -1), of a task's rows."""
    def fn(batches):
        total = None
        for x in _matrices(batches):
            y = move(x)
            part = np.concatenate([(y.T @ y)[np.triu_indices(y.shape[1])], y.sum(0)])
            total = part if total is None else total + part
        if total is not None:
            d = int((np.sqrt(9 + 8 * len(total)) - 3) / 2 + 0.5)
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, np.arange(d)), pa.int32()),
                                              pa.array(np.append(j, np.full(d, -1)), pa.int32()), pa.array(total)], ["i", "j", "v"])
    return fn


def _covariance(fit: DataFrame, n: int, d: int, move) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the products of ``move(x)`` and of ``move(x)`` itself."""
    rows = fit.mapInArrow(_products(move), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    c, mean = np.zeros((d, d)), np.zeros(d)
    for i, j, v in rows:  # one row per entry of the matrix
        if j < 0:
            mean[i] = v / n
        else:
            c[i, j] = c[j, i] = v / n
    return c, mean


def fit_whitening(x: DataFrame, d: int, components: int) -> Whitening:
    """From the distinct vectors of column ``x`` (arrays of ``d`` whole numbers, no nulls)."""
    with Scratch(x.sparkSession) as keep:
        fit = keep(x.groupBy("x").agg(F.lit(1).alias("one")).select("x"))
        rows = fit.mapInArrow(_sums, "i int, v long").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
        total = {i: int(v) for i, v in rows}
        n, sums = total.get(d, 0), [total.get(i, 0) for i in range(d)]
        if not n:
            return Whitening(0, sums, 0.0, np.zeros(0), np.zeros((0, d)), 0.0)
        mean = np.array([s / n for s in sums])
        v, left = _covariance(fit, n, d, lambda x: x - mean)
        values, rows = leading_components(v, components)
        out = Whitening(n, sums, float(np.trace(v)), values, rows, 0.0)
        if len(values):
            back = rows.T / np.sqrt(values)
            middle = left @ back  # rounding only
            w, _ = _covariance(fit, n, len(values), lambda x: (x - mean) @ back - middle)
            out.identity_error = float(np.abs(w - np.eye(len(values))).max())
        return out


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2, exactly; null where it exceeds a long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if x.shape[1] * most ** 2 < 2 ** 62:
        return ((n * x - np.array(sums)) ** 2).sum(1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [e if e < 2 ** 63 else None for e in exact]


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per vector and component.

    Entries become whole numbers floor(scale * c). Rows whose vector is null or
    holds a null or non-finite entry are left out; a shorter vector counts as
    followed by zeros. Each distinct vector counts once in the fit. Components
    whose variance is zero to rounding do not exist, so fewer than ``components``
    may come, and none where all vectors are equal or the table is empty. Null
    and repeated identifiers stay as they are, a row each. ``deviation`` is null
    where it exceeds a long.
    """
    x = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), whole_numbers(F.col(f"`{vector_col}`"), scale).alias("x"))
    x = x.filter("x IS NOT NULL")
    d = x.agg(F.max(F.size("x"))).first()[0] or 0
    x = x.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))))
    w = fit_whitening(x.select("x"), d, components)
    mean = np.array([s / w.n for s in w.sums]) if w.n else np.zeros(d)

    def project(batches):
        k = len(w.values)
        for b in batches:
            if not b.num_rows or not k:
                continue
            m = b.num_rows
            xs = b.column("x").flatten().to_numpy().reshape(m, d)
            z = (xs - mean) @ (w.components.T / np.sqrt(w.values))
            rows = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, w.n)), pa.array(_deviation(xs, w.n, w.sums), pa.int64()).take(pa.array(rows)),
                pa.array(z.ravel()), pa.array(np.tile(w.values / w.trace, m)), pa.array(np.full(m * k, w.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, "
                                 "identity_error double")
