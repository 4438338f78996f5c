"""Histogram boosting against a plain implementation, and its edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import boosting as B


def plain(x, y, cuts, classes, booster, base):
    """Boosting node by node with a loop over every cut, no histograms."""
    k = max(classes, 1)
    margins = np.tile(base, (len(y), 1))

    def score(g, h):
        return g * g / (h + booster.l2) if h + booster.l2 > 0 else 0.0

    def grow(rows, g, h, depth, out, c):
        G, H = g[rows].sum(), h[rows].sum()
        best = (1e-9, None)
        if depth:
            for j, points in enumerate(cuts):
                for p in points:
                    low = rows & (x[:, j] <= p)
                    high = rows & ~(x[:, j] <= p)
                    if h[low].sum() >= booster.min_hessian and h[high].sum() >= booster.min_hessian:
                        gain = score(g[low].sum(), h[low].sum()) + score(g[high].sum(), h[high].sum()) - score(G, H)
                        if gain > best[0] + 1e-9:
                            best = (gain, (low, high))
        if best[1] is None:
            if rows.any():
                out[rows, c] += -booster.rate * G / (H + booster.l2)
            return
        for side in best[1]:
            grow(side, g, h, depth - 1, out, c)

    for _ in range(booster.iterations):
        if classes:
            p = B.softmax(margins)
            g, h = p - np.eye(classes)[y.astype(int)], p * (1 - p) * classes / (classes - 1)
        else:
            g, h = margins - y[:, None], np.ones((len(y), 1))
        step = np.zeros_like(margins)
        for c in range(k):
            grow(np.ones(len(y), bool), g[:, c], h[:, c], booster.depth, step, c)
        margins = margins + step
    return margins


@pytest.mark.parametrize("classes", [3, 0])
def test_boosting_equals_a_plain_implementation(spark, classes):
    r = np.random.default_rng(3)
    x = np.stack([r.normal(size=150), r.integers(0, 6, 150).astype(float)], axis=1)
    y = ((x[:, 0] > 0.2) + (x[:, 1] > 2)).astype(float) if classes else x[:, 0] * 3 + (x[:, 1] > 3) * 10 + r.normal(size=150)
    df = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(3)
    boosters = [B.Booster("a", 4, 0.3, 3), B.Booster("b", 2, 0.1, 2, l2=0.5)]
    for m, booster in zip(B.fit(df, F.col("x"), F.col("y"), boosters, classes, bins=16), boosters):
        want = plain(x, y, m.cuts, classes, booster, m.base)
        assert np.allclose(m.margins(x), want, atol=1e-4)
        assert len(m.losses) == booster.iterations + 1 and all(b < a for a, b in zip(m.losses, m.losses[1:]))
        last = B.gradients(y, want, classes, 2.0 ** -30)[2] / len(y)
        assert abs(last - m.losses[-1]) < 1e-3 * max(1, last)


def test_a_fit_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(B, "ROWS_PER_TASK", 40)
    monkeypatch.setattr(B, "CHECKPOINT_EVERY", 2)
    r = np.random.default_rng(5)
    rows = [(r.normal(size=4).tolist(), float(r.integers(0, 4))) for _ in range(400)]
    df = spark.createDataFrame(rows, "x array<double>, y double")
    one, many = (B.fit(d, F.col("x"), F.col("y"), [B.Booster("a", 5, 0.2, 4)], 4)[0] for d in (df.coalesce(1), df.repartition(9)))
    assert np.array_equal(one.feature, many.feature) and np.array_equal(one.cut, many.cut) and np.array_equal(one.leaf, many.leaf)


def test_boosting_edges(spark):
    schema = "x array<double>, y double"
    assert B.fit(spark.createDataFrame([], schema), F.col("x"), F.col("y"), [B.Booster("a", 2, 0.1, 2)], 2) is None
    nan = float("nan")
    rows = [([float(i), 1.0], float(i > 5)) for i in range(12)] + [(None, 1.0), ([1.0, None], 0.0), ([nan, 1.0], 0.0), ([2.0, 2.0], None)]
    df = spark.createDataFrame(rows, schema)
    m = B.fit(df, F.col("x"), F.col("y"), [B.Booster("a", 20, 0.3, 2)], 2)[0]
    got = df.select("x", "y", m.predict(F.col("x")).alias("p")).collect()
    assert all(abs(sum(g.p) - 1) < 1e-12 and g.p[int(g.y)] > 0.6 for g in got[:12])
    assert got[12].p is None and got[14].p[1] > 0.6
    same = B.fit(df.limit(3), F.col("x"), F.lit(7.0), [B.Booster("a", 3, 0.5, 3)], 0)[0]  # nothing to split or to learn
    assert np.allclose(same.margins(np.array([[0.0, 1.0]])), 7.0)


def test_registered_schedules_are_the_full_ones():
    from furrow.plans import q_models as q
    assert [(b.iterations, b.rate, b.depth) for b in q.CROP_BOOSTERS + q.FERT_BOOSTERS + q.YIELD_BOOSTERS] == [
        (200, 0.1, 6), (300, 0.05, 6), (200, 0.05, 4), (200, 0.1, 6), (200, 0.05, 5)]
