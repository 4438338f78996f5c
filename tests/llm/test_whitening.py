"""Whitening against a plain eigendecomposition."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import whitening
from furrow.llm.queries import QUERIES


def spectrum(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    v = q * np.array(values) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 40), [5.0, 4.0, 3.0], [1.0], [9, 9, 9, 9, 9, 9, 1, 1], [1e6, 1, 1e-3, 1e-5, 0, 0], 1 + 1e-7 * np.arange(30),
    [3.0, 2.0, 1.0] + [0.0] * 9])
def test_components_equal_a_full_decomposition(values):
    v = spectrum(np.array(values, dtype=float), 3)
    for k in {1, min(4, len(v)), len(v)}:
        e, x = whitening.components(v, k)
        want = np.linalg.eigvalsh(v)[::-1][:k]
        assert np.allclose(e, np.where(want > 1e-13 * want[0], want, 0), atol=2e-14 * want[0] * len(v), rtol=1e-12)
        some = e > 0
        assert np.allclose(x[:, some].T @ x[:, some], np.eye(some.sum()), atol=1e-9)
        assert np.abs(v @ x - x * e).max() <= 1e-12 * want[0]


def test_inertia_counts():
    v = spectrum(np.arange(1.0, 31), 1)
    assert whitening.Inertia(v).above([0, 0.5, 10.5, 29.5, 31]).tolist() == [30, 30, 20, 1, 0]
    assert sum(c for *_, c in whitening.intervals(whitening.Inertia(v), 30, v.trace())) == 30


def brute(rows, k):
    """{(id, component): (n, deviation, |whitened|, explained)}; deviations in whole numbers."""
    x = {i: np.floor(256 * np.array(v, dtype=float)).astype(int) for i, v in rows}
    fit = np.array(sorted({tuple(v.tolist()) for v in x.values()}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = {}
    for i, v in x.items():
        w = (v - sums / n) @ u / np.sqrt(e)
        for c in range(k):
            out[i, c + 1] = (n, sum(int(a) ** 2 for a in n * v - sums), w[c], e[c] / cov.trace())
    return out


def compare(got, want):
    assert sorted((r.vec_id, r.component) for r in got) == sorted(want)
    sign = {}
    for r in got:
        n, deviation, w, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation) and r.explained == pytest.approx(explained, rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(w), abs=1e-8) and r.identity_error < 1e-9
        if abs(w) > 1e-3:
            assert sign.setdefault(r.component, r.whitened * w > 0) == (r.whitened * w > 0)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(QUERIES["op13_embedding_whitening"](spark, sf).collect(), brute(rows, 4))


SCHEMA = "vec_id long, embedding array<float>, x string, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 0) for i, v in rows], SCHEMA)


def test_copies_and_bad_rows(spark):
    r = np.random.default_rng(0)
    good = [(i, [float(a) for a in r.normal(size=6).astype(np.float32)]) for i in range(40)]
    copies = [(100 + i, good[3][1]) for i in range(300)]
    bad = [(500, None), (501, []), (502, [1.0] * 5 + [None]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (505, [1.0] * 7)]
    compare(whitening.whiten(table(spark, good + copies + bad).repartition(7)).collect(), brute(good + copies, 4))
    twice = whitening.whiten(table(spark, good + good)).collect()
    assert len(twice) == 8 * len(good)
    assert whitening.whiten(table(spark, [(None, v) for _, v in good])).where("vec_id is null").count() == 4 * len(good)


def test_degenerate_tables(spark):
    assert whitening.whiten(table(spark, [(500, None)])).count() == 0
    assert whitening.whiten(table(spark, []).limit(0)).count() == 0
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {
        (i, c, 1, 0, None, 0.0, None) for i in (1, 2) for c in (1, 2)}
    two = whitening.whiten(table(spark, [(1, [0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0])])).collect()
    assert [(r.component, r.whitened is None) for r in sorted(two)] == [(1, False), (2, True), (3, True)] * 2


def test_sums_stay_exact_for_large_entries(spark):
    rows = [(0, [3e9, 1.0]), (1, [-3e9, 0.5]), (2, [12.25, 7e9]), (3, [3e18, 0.0])]
    got = whitening.whiten(table(spark, rows), k=1).collect()
    x = {i: [int(np.floor(256 * np.float64(np.float32(a)))) for a in v] for i, v in rows}
    x[3][0] = 2 ** 63 - 1  # saturates
    sums = [sum(v[j] for v in x.values()) for j in range(2)]
    dev = {i: sum((4 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in x.items()}
    assert {r.vec_id: r.deviation for r in got} == {i: d if d < 2 ** 63 else None for i, d in dev.items()}
    n, s, cov = whitening.moments(whitening.quantise(table(spark, rows)).select("x"), 2)
    want = [[float(sum((Fraction(v[a]) - Fraction(sums[a], 4)) * (Fraction(v[b]) - Fraction(sums[b], 4)) for v in x.values()) / 4)
             for b in range(2)] for a in range(2)]
    assert s == sums and cov.tolist() == want
