"""Embedding whitening on components found by FEAST contour integration.

Spark does what grows with the rows: quantising, the list of distinct vectors (one shuffle with map-side combine, so copies of a
hot vector cost one row a task), exact sums and centred products as small partial aggregates of each task, the projection of all
rows, and the check of the result. What reaches the driver is bounded by the dimension d alone: d sums and d (d + 1) / 2 products.

*Covariance.* Vectors are whole numbers, so sums are exact. Products are taken of entries less the rounded mean and corrected in
whole numbers; the covariance is the exact one, rounded once, and does not depend on the order or the number of tasks.

*FEAST.* A Householder reduction to tridiagonal form gives, for any shift, the signs of the pivots of V - shift: by Sylvester's law
of inertia the number of eigenvalues above the shift. Bisection on these counts cuts the wanted part of the spectrum, in its gaps,
into intervals. For each interval a Gauss quadrature over a circle around it sums complex shifted solves ``(z - V)^-1 Y``, which
projects a random block onto the interval's eigenvectors; Rayleigh-Ritz in that block extracts them, and the block is filtered again
until the residual is at rounding level. An interval is done only if it holds as many Ritz values as the inertia counts say; else the
block grows, up to the whole space, so none is missed.

Defined edge cases: vectors that are null, empty, or hold a null or non-finite entry are dropped; of several lengths the one with the
most distinct vectors counts (ties: the longest), others are dropped as incomplete; a null id is kept; repeated rows are returned
each, once in the fit list; a component without variance (fewer distinct vectors than components, constant entries) has null
``whitened`` and ``explained`` 0; a deviation beyond 64 bits is null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.words import lists
from furrow.session import drop_scratch, written

ROWS = 1024
POINTS = 8
SLICE = 16
EXACT = 2 ** 53
_SUMS = "i int, j int, v decimal(38,0)"


@dataclass
class Whitening:
    """A fitted model; its size depends on the dimension and the number of components only."""

    n: int
    sums: list[int]           # exact, by dimension
    values: np.ndarray        # eigenvalues, falling
    vectors: np.ndarray       # d x k, unit columns
    trace: float
    identity_error: float | None = None

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def usable(self) -> np.ndarray:
        """Components with variance above rounding level."""
        return self.values > max(self.dim, 1) * np.finfo(float).eps * self.trace


def quantise(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """All columns and x: every entry, as double, times 256, rounded down to a long. Rows without a whole vector are dropped."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return (rows.where((F.size(vector) > 0) & whole)
            .withColumn("x", F.transform(vector, lambda c: F.floor(c.cast("double") * 256))))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Row blocks and their vectors (whole numbers, n x dim)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield part, lists(part.column("x"))[0].reshape(-1, dim)


def _reach(x: np.ndarray) -> int:
    """Largest absolute entry, exact."""
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def _exact(x: np.ndarray, factor: int, shift: list[int]) -> np.ndarray:
    """factor * x - shift in whole numbers: 64-bit where it fits, Python numbers elsewhere."""
    if _reach(x) * factor + max(map(abs, shift)) < 2 ** 62:
        return x * np.int64(factor) - np.array(shift, dtype=np.int64)
    return x.astype(object) * factor - np.array(shift, dtype=object)


def _products(c: np.ndarray) -> np.ndarray:
    """c' c in whole numbers; double arithmetic is exact below 2**53."""
    if c.dtype != object and len(c) * _reach(c) ** 2 < EXACT:
        d = c.astype(np.float64)
        return (d.T @ d).astype(np.int64).astype(object)
    c = c.astype(object)
    return c.T @ c


def _totals(found: DataFrame) -> dict[tuple[int, int], int]:
    return {(r.i, r.j): int(r.v) for r in found.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}


def _numbers(i, j, v) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                       pa.array([Decimal(int(a)) for a in v], pa.decimal128(38, 0))], ["i", "j", "v"])


def moments(fit: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, covariance) of a stored list of distinct vectors x."""
    def add(batches):
        total = np.zeros(dim + 1, dtype=object)
        for _, x in _blocks(batches, dim):
            total[:dim] += x.sum(axis=0).astype(object) if _reach(x) * ROWS < 2 ** 62 else x.astype(object).sum(axis=0)
            total[dim] += len(x)
        yield _numbers(np.arange(dim + 1), np.zeros(dim + 1, int), total)

    got = _totals(fit.mapInArrow(add, _SUMS))
    n, sums = got[dim, 0], [got[i, 0] for i in range(dim)]
    mean = [(2 * s + n) // (2 * n) for s in sums]
    upper = np.triu_indices(dim)

    def multiply(batches):
        total = np.zeros((dim, dim), dtype=object)
        for _, x in _blocks(batches, dim):
            total += _products(_exact(x, 1, mean))
        yield _numbers(*upper, total[upper])

    got = _totals(fit.mapInArrow(multiply, _SUMS))
    rest = [s - n * m for s, m in zip(sums, mean)]
    cov = np.zeros((dim, dim))
    for (i, j), v in got.items():
        cov[i, j] = cov[j, i] = (n * v - rest[i] * rest[j]) / (n * n)
    return n, sums, cov


# eigenvalue intervals -----------------------------------------------------------------------------------------------------

def _tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder reflections)."""
    a = v.copy()
    n = len(a)
    for k in range(n - 2):
        u = a[k + 1:, k].copy()
        length = np.linalg.norm(u)
        if length == 0:
            continue
        u[0] += np.copysign(length, u[0])
        u /= np.linalg.norm(u)
        p = a[k + 1:, k + 1:] @ u
        q = p - (u @ p) * u
        a[k + 1:, k + 1:] -= 2 * (np.outer(u, q) + np.outer(q, u))
        a[k + 1:, k] -= 2 * u * (u @ a[k + 1:, k])
        a[k, k + 1:] = a[k + 1:, k]
    return np.diag(a).copy(), np.diag(a, 1).copy()


class Inertia:
    """Eigenvalues above a shift, counted from the signs of the pivots of the shifted matrix."""

    def __init__(self, v: np.ndarray):
        self.diag, self.off = _tridiagonal(v)
        self.tiny = np.finfo(float).eps ** 2 * max(np.abs(self.diag).max(), np.abs(self.off).max(initial=0), 1e-300)

    def above(self, shifts: np.ndarray) -> np.ndarray:
        shifts = np.atleast_1d(np.asarray(shifts, dtype=float))
        pivot = self.diag[0] - shifts
        count = (pivot > 0).astype(int)
        for k in range(1, len(self.diag)):
            pivot = np.where(np.abs(pivot) < self.tiny, -self.tiny, pivot)
            pivot = self.diag[k] - shifts - self.off[k - 1] ** 2 / pivot
            count += pivot > 0
        return count

    def largest(self, k: int, top: float) -> np.ndarray:
        """The k largest eigenvalues, by bisection (they place the intervals; the components come from the projection)."""
        low, high, rank = np.zeros(k), np.full(k, top), np.arange(1, k + 1)
        for _ in range(60):
            mid = (low + high) / 2
            inside = self.above(mid) >= rank
            low, high = np.where(inside, mid, low), np.where(inside, high, mid)
        return (low + high) / 2


def intervals(inertia: Inertia, k: int, top: float) -> list[tuple[float, float, int]]:
    """(low, high, count), from the largest down: intervals that hold at least the k largest eigenvalues, cut within gaps."""
    d = len(inertia.diag)
    at = inertia.largest(min(d, k + SLICE), top)
    out, done, high = [], 0, float(at[0] + 0.25 * (at[0] - at[-1]) + 1e-3 * top)
    while done < k:
        ends = np.arange(done + 1, min(done + SLICE, len(at)) + 1) if k - done > SLICE else np.arange(k, len(at) + 1)
        gaps = np.array([at[e - 1] - at[e] if e < len(at) else (0.0 if len(at) < d else at[e - 1]) for e in ends])
        if k - done <= SLICE:  # the first clear gap from the k-th on
            clear = np.flatnonzero(gaps > 1e-9 * top)
            pick = int(clear[0]) if len(clear) else int(np.argmax(gaps))
        else:
            pick = len(ends) // 2 + int(np.argmax(gaps[len(ends) // 2:]))
        end = int(ends[pick])
        low = float((at[end - 1] + at[end]) / 2) if end < len(at) else float(at[end - 1] / 2)
        count = int(inertia.above(low)[0] - inertia.above(high)[0])
        out.append((low, high, count))
        done, high = done + count, low
    return out


def project(v: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All `count` eigenvalues in (low, high] and their unit eigenvectors, by filtered subspace iteration."""
    d = len(v)
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    turns = radius * np.exp(0.5j * np.pi * (nodes + 1))
    scale = np.abs(v).sum(axis=1).max()
    size = min(d, 2 * count + 8)
    while True:
        block = np.random.default_rng(seed).normal(size=(d, size))
        last = np.inf
        for _ in range(60):
            if size < d:
                block = sum(0.5 * w * (t * np.linalg.solve((centre + t) * np.eye(d) - v, block.astype(complex))).real
                            for t, w in zip(turns, weights))
            basis, _ = np.linalg.qr(block)
            ritz, turn = np.linalg.eigh(basis.T @ v @ basis)
            block = basis @ turn
            inside = (ritz > low) & (ritz <= high)
            residual = np.linalg.norm(v @ block[:, inside] - block[:, inside] * ritz[inside], axis=0).max(initial=0.0)
            if inside.sum() == count and (residual <= 1e-15 * scale or (residual <= 1e-11 * scale and residual > last / 2)):
                order = np.argsort(-ritz[inside])
                return ritz[inside][order], block[:, inside][:, order]
            last = residual
        if size == d:
            raise ArithmeticError(f"{inside.sum()} of {count} components found between {low} and {high}")
        size = min(d, 2 * size)


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a positive semidefinite matrix and unit eigenvectors (sign: the largest entry is positive).
    Eigenvalues at rounding level are returned as zeros with zero vectors."""
    d, trace = len(v), float(np.trace(v))
    values, vectors = np.zeros(k), np.zeros((d, k))
    if trace <= 0:
        return values, vectors
    inertia = Inertia(v)
    top = trace * (1 + 1e-9)
    rank = min(k, int(inertia.above(2 * d * np.finfo(float).eps * trace)[0]))
    found = [project(v, *part, seed=i) for i, part in enumerate(intervals(inertia, rank, top))]
    e = np.concatenate([f[0] for f in found])[:rank]
    x = np.concatenate([f[1] for f in found], axis=1)[:, :rank]
    if len(found) > 1:  # intervals cut in a narrow gap leave vectors orthogonal to rounding over that gap only
        x = np.linalg.qr(x)[0]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(rank)] < 0, -1.0, 1.0)
    values[:rank], vectors[:, :rank] = e, x
    return values, vectors


# fitting and use ----------------------------------------------------------------------------------------------------------

def _whiten(model: Whitening, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x - S, whitened) of a block; components without variance are NaN."""
    off = _exact(x, model.n, model.sums)
    centred = off.astype(np.float64) / model.n
    with np.errstate(divide="ignore", invalid="ignore"):
        out = centred @ model.vectors / np.sqrt(model.values)
    out[:, ~model.usable] = np.nan
    return off, out


def _identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = int(model.usable.sum())
    if not k:
        return None

    def add(batches):
        total = np.zeros((k + 1, k))
        for _, x in _blocks(batches, model.dim):
            w = _whiten(model, x)[1][:, :k]
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        i, j = np.divmod(np.arange(total.size), k)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    rows = fit.mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((k + 1, k))
    for r in rows:
        total[r.i, r.j] = r.v
    total /= model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def fit(rows: DataFrame, k: int) -> Whitening | None:
    """A model of rows with a quantised vector x; None without rows."""
    distinct = written(rows.select("x").groupBy("x").agg(F.lit(1).alias("one")).select("x"), "vectors")
    size = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    model = None
    if size is not None:
        same = distinct.where(F.size("x") == size.d)
        n, sums, cov = moments(same, size.d)
        model = Whitening(n, sums, *components(cov, min(k, size.d)), float(np.trace(cov)))
        model.identity_error = _identity_error(same, model)
    drop_scratch(distinct)
    return model


def apply(rows: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of rows with a quantised vector x."""
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType)]).add("component", "integer").add("deviation", "long").add("whitened", "double")
    k = len(model.values)

    def run(batches):
        for part, x in _blocks(batches, model.dim):
            off, w = _whiten(model, x)
            if off.dtype != object and model.dim * _reach(off) ** 2 < 2 ** 63:
                deviation = pa.array((off * off).sum(axis=1), pa.int64())
            else:
                exact = (off.astype(object) ** 2).sum(axis=1)
                deviation = pa.array([v if v < 2 ** 63 else None for v in map(int, exact)], pa.int64())
            row = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [part.column(key).take(row), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), deviation.take(row),
                 pa.array(w.ravel(), mask=np.isnan(w.ravel()))], schema.names)

    share = [float(v) / model.trace if ok else 0.0 for v, ok in zip(model.values, model.usable)]
    explained = F.element_at(F.array(*[F.lit(s) for s in share]), F.col("component"))
    return (rows.where(F.size("x") == model.dim).select(key, "x").mapInArrow(run, schema)
            .select(key, "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"),
                    F.lit(model.identity_error).cast("double").alias("identity_error")))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 4) -> DataFrame:
    """Fits on the distinct vectors of a table and whitens all its rows."""
    x = quantise(rows.select(key, vector), vector).select(key, "x")
    model = fit(x, k)
    if model is None:
        model = Whitening(0, [0], np.zeros(1), np.zeros((1, 1)), 0.0)
    return apply(x, model, key)
