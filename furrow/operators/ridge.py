"""Ridge regression in closed form: one pass over the rows, then a d x d system.

All second moments are central moments, which merge across partitions without cancellation: a task sums its Arrow batches as matrix
products and sends d (d + 1) + 1 numbers. (One SQL aggregate of all d (d + 1) / 2 pairs is too large a method for the JVM's compiler.) With standardised features Z (population deviation) the coefficients
solve ``(Z'Z + alpha I) w = Z'y`` by Cholesky. There is no iteration and no cached table.

Rows with a null feature or target take no part; a feature without variance gets coefficient 0; no rows give no model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def central_moments(df: DataFrame, columns: dict[str, Column]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, population covariance) of the rows where all columns are known, in one aggregate."""
    names = list(columns)
    t = df.select(*[columns[c].cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    d = len(names)

    def run(batches):
        total = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            x = x[:, ~np.isnan(x).any(axis=0)]  # a null is NaN here
            if x.shape[1]:
                m = x.mean(axis=1)
                x = x - m[:, None]
                total = _merged(total, (x.shape[1], m, x @ x.T))
        yield pa.RecordBatch.from_pydict({"n": [total[0]], "m": [total[1].tolist()], "s": [total[2].ravel().tolist()]})

    total = 0, np.zeros(d), np.zeros((d, d))
    for r in t.mapInArrow(run, "n long, m array<double>, s array<double>").collect():  # d (d + 1) + 1 numbers a task
        total = _merged(total, (r["n"], np.array(r["m"]), np.array(r["s"]).reshape(d, d)))
    n, mean, sums = total
    return n, mean, sums / max(n, 1)


def _merged(a, b):
    """(n, means, sums of centred products) of two disjoint sets of rows."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    shift = b[1] - a[1]
    return n, a[1] + shift * (b[0] / n), a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n)


def gram(df: DataFrame, columns: dict[str, Column], decimals: int = 6) -> DataFrame:
    """The centred Gram matrix over n as a long table (a, b, n, covariance)."""
    names = list(columns)
    n, _, cov = central_moments(df, columns)
    rows = [(a, b, n, round(float(cov[i, j]), decimals)) for i, a in enumerate(names) for j, b in enumerate(names)] if n else []
    return df.sparkSession.createDataFrame(rows, "a string, b string, n long, covariance double")


@dataclass
class Ridge:
    """A fitted model; ``predict`` is plain column arithmetic."""

    means: np.ndarray
    scales: np.ndarray
    coefficients: np.ndarray
    intercept: float

    def predict(self, xs: list[Column]) -> Column:
        out = F.lit(float(self.intercept))
        for x, m, s, w in zip(xs, self.means, self.scales, self.coefficients):
            out = out + (x - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(w))
        return out


def fit(df: DataFrame, xs: list[Column], y: Column, alpha: float = 1.0) -> Ridge | None:
    """Ridge of y on standardised xs; None without complete rows."""
    n, mean, cov = central_moments(df, {f"x{i}": x for i, x in enumerate(xs)} | {"y": y})
    if not n:
        return None
    d = len(xs)
    spread = np.sqrt(np.maximum(np.diag(cov)[:d], 0))
    flat = spread <= 1e-14 * np.maximum(np.abs(mean[:d]), 1e-300)
    scales = np.where(flat, 1.0, spread)
    z = n * cov[:d, :d] / np.outer(scales, scales)
    right = n * cov[:d, d] / scales
    z[flat], z[:, flat], right[flat] = 0, 0, 0
    low = np.linalg.cholesky(z + alpha * np.eye(d))
    return Ridge(mean[:d], scales, np.linalg.solve(low.T, np.linalg.solve(low, right)), float(mean[d]))
