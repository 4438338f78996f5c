"""Property tests for model operators (model outputs have no SQL oracle)."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from furrow.operators import models
from furrow.plans import q_models
from furrow.sources import fixtures as fx


def test_forest_probabilities_importances_and_roundtrip(spark, sf, tmp_path):
    tr, te = q_models.crop_split(spark, sf)
    m = models.fit_pipeline(tr, fx.CROP_FEATURES, [], "Crop", models.classifier("random_forest", 7, num_trees=10))
    p = m.transform(te).select(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, v: a + v).alias("s"))
    assert all(abs(r.s - 1.0) < 1e-9 for r in p.collect())
    imp = models.feature_importance(m.stages[-1], fx.CROP_FEATURES)
    assert abs(sum(v for _, v in imp) - 1.0) < 1e-9
    acc = q_models._acc_row(spark, "crop", "rf", m.transform(te)).first()["accuracy"]
    assert acc > 100.0 / 22 * 3  # far better than guessing among 22 crops
    from pyspark.ml import PipelineModel
    m.write().overwrite().save(str(tmp_path / "m"))
    m2 = PipelineModel.load(str(tmp_path / "m"))
    a = m.transform(te).select("obs_id", F.col("prediction").alias("a"))
    b = m2.transform(te).select("obs_id", F.col("prediction").alias("b"))
    assert a.join(b, "obs_id").filter("a <> b").count() == 0


def test_fertilizer_and_yield_records_are_scored(spark, sf):
    f = q_models.score_fertilizer(spark, sf).toPandas()
    assert len(f) == fx.obs(spark, sf).count() and f["confidence"].between(0, 100).all()
    assert (f["top3"].str.count(r"%\)") == 3).all()
    y = q_models.score_yield(spark, sf).toPandas()
    assert len(y) and (y["predicted"] >= 0).all()
    band = y["predicted"].map(lambda v: "Excellent" if v >= 5 else "Good" if v >= 2.5 else "Average" if v >= 1 else "Low")
    edge = y["predicted"].isin([1.0, 2.5, 5.0])
    assert (edge | (band == y["rating"])).all()


def test_rff_kernel_approximation(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    gamma = 0.2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<double>")
    z = np.array([r.z for r in df.select("i", models.rff_features(F.col("x"), 3, 400, gamma).alias("z"))
                  .orderBy("i").collect()])
    approx = z @ z.T
    exact = np.exp(-gamma * ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    assert np.abs(approx - exact).mean() < 0.05


def test_ridge_classifier_predicts_valid_classes(spark, sf):
    tr, te = q_models.crop_split(spark, sf)
    m = models.fit_ridge_classifier(tr, fx.CROP_FEATURES, [], "Crop")
    preds = models.ridge_class_predictions(m, te, 22).select("prediction").distinct().collect()
    assert all(0 <= r.prediction <= 21 and r.prediction == int(r.prediction) for r in preds)


def test_shapley_is_additive_and_matches_forest(spark, sf):
    from furrow.operators import explain
    tr, te = q_models.crop_split(spark, sf)
    m = models.fit_pipeline(tr, fx.CROP_FEATURES, [], "Crop",
                            models.classifier("random_forest", 7, num_trees=4, max_depth=5))
    long = explain.explain_rows(spark, m, te, "obs_id", fx.CROP_FEATURES)
    per = long.groupBy("row_id").agg(F.sum("contribution").alias("s"), F.first("base").alias("b"),
                                     F.first("prob").alias("p"), F.first("pred_class").alias("c"))
    probs = m.transform(te).select(F.col("obs_id").alias("row_id"), vector_to_array("probability").alias("pv"))
    j = per.join(probs, "row_id").toPandas()
    assert len(j) == te.count()
    assert np.allclose(j["b"] + j["s"], j["p"], atol=1e-9)
    assert np.allclose(j["p"], [pv[c] for pv, c in zip(j["pv"], j["c"])], atol=1e-9)


def subsets_by_brute_force(trees, x, cls):
    """Shapley values over all feature subsets, with expectations by walking the trees."""
    from itertools import combinations
    from math import factorial

    def expect(t, fixed, row, c, node=0):
        left, right = t["left"][node], t["right"][node]
        if left < 0:
            return t["value"][node][c]
        f = t["feat"][node]
        if f in fixed:
            go = row[f] in t["cats"][node] if t["cats"][node] is not None else row[f] <= t["thr"][node]
            return expect(t, fixed, row, c, left if go else right)
        a, b = t["cover"][left], t["cover"][right]
        return (a * expect(t, fixed, row, c, left) + b * expect(t, fixed, row, c, right)) / (a + b)

    m = x.shape[1]
    out = np.zeros(x.shape)
    for r, (row, c) in enumerate(zip(x, cls)):
        v = {s: sum(expect(t, s, row, c) for t in trees) / len(trees) for k in range(m + 1) for s in combinations(range(m), k)}
        for s in v:
            for i in set(range(m)) - set(s):
                w = factorial(len(s)) * factorial(m - len(s) - 1) / factorial(m)
                out[r, i] += w * (v[tuple(sorted((*s, i)))] - v[s])
    return out


def test_shapley_equals_all_subsets_with_categories(spark):
    from furrow.operators import explain, ranking
    r = np.random.default_rng(4)
    rows = [(i, float(r.normal()), float(r.integers(0, 5)), f"k{r.integers(0, 6)}", f"c{int(r.integers(0, 3))}") for i in range(400)]
    rows = [(i, a, b, k, "c0" if a > 0.3 and k in ("k1", "k4") else y) for i, a, b, k, y in rows]
    df = spark.createDataFrame(rows, "obs_id long, a double, b double, k string, y string")
    m = models.fit_pipeline(df, ["a", "b"], ["k"], "y", models.classifier("random_forest", 3, num_trees=5, max_depth=6))
    trees = explain.forest_tables(spark, m.stages[-1])
    leaves = explain.leaf_table(trees, 3)
    assert leaves.allowed and len(leaves.groups(leaves.nbytes // 3)) >= 3
    got = explain.explained(spark, m, df.limit(25), "obs_id").orderBy("row_id").collect()
    x, cls = np.array([g.x for g in got]), np.array([g.pred_class for g in got])
    want = subsets_by_brute_force(trees, x, cls)
    assert np.allclose([g.phi for g in got], want, atol=1e-10)
    assert np.allclose([g.base + sum(g.phi) for g in got], [g.prob for g in got], atol=1e-10)
    split = sum(np.concatenate([p[0], p[1][:, None], p[2][:, None]], axis=1) for p in
                (explain.shapley(g, x, cls) for g in leaves.groups(leaves.nbytes // 3)))
    assert np.allclose(split[:, :3], want, atol=1e-10)
    top = explain.explain_top(spark, m, df, "obs_id", ["a", "b", "k"])
    long = ranking.top_contributions(explain.explain_rows(spark, m, df, "obs_id", ["a", "b", "k"]), "row_id")
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, long.select(*top.columns).collect()))
    assert "Window" not in top._jdf.queryExecution().optimizedPlan().toString()


def test_closed_form_ridge_equals_the_iterative_fit(spark, sf):
    from furrow.operators import ridge
    tr, _ = q_models.crop_split(spark, sf)
    old = models.fit_ridge_classifier(tr, fx.CROP_FEATURES, [], "Crop")
    new = ridge.fit(old.stages[0].transform(tr), q_models._raw(7), F.col("label_idx"))
    assert np.allclose(new.coefficients, old.stages[1].coefficients.toArray(), atol=1e-6) and abs(new.intercept - old.stages[1].intercept) < 1e-6
    both = old.transform(tr).withColumn("new", new.predict(q_models._raw(7)))
    assert both.where("abs(prediction - new) > 1e-5").isEmpty()


def test_ridge_against_normal_equations_and_edges(spark):
    from furrow.operators import ridge
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 3)) * [1, 50, 1e-3] + [1e6, 0, 5]
    y = x @ [2.0, -0.1, 300.0] + r.normal(size=60)
    rows = [(*map(float, a), float(b), 7.0) for a, b in zip(x, y)] + [(None, 1.0, 1.0, 1.0, 7.0), (1.0, 1.0, 1.0, None, 7.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, flat double")
    m = ridge.fit(df, [F.col(c) for c in ("a", "b", "c", "flat")], F.col("y"), alpha=2.5)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = np.linalg.solve(z.T @ z + 2.5 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(m.coefficients, [*want, 0], rtol=1e-8) and abs(m.intercept - y.mean()) < 1e-6
    assert ridge.fit(df.limit(0), [F.col("a")], F.col("y")) is None and ridge.gram(df.limit(0), {"a": F.col("a")}).count() == 0


def test_features_are_scaled_by_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (6.0, "a")], "x double, y string")
    m = models.fit_features(df, ["x"], [], "y")
    got = [r.v[0] for r in m.transform(df).select(vector_to_array("features").alias("v")).collect()]
    x = np.array([1.0, 2.0, 6.0])
    assert np.allclose(sorted(got), (x - x.mean()) / x.std())


def test_tree_bins_follow_the_categories(spark):
    rows = [(f"c{i % 90:02d}", float(i % 7), i % 2) for i in range(900)]
    df = spark.createDataFrame(rows, "c string, x double, y int").withColumn("y", F.col("y").cast("string"))
    est = models.classifier("random_forest", 2, num_trees=2, max_depth=3)
    m = models.fit_pipeline(df, ["x"], ["c"], "y", est)
    assert m.stages[-1].getOrDefault("maxBins") == 91
    assert m.transform(df).count() == 900


def test_moments_leave_out_nulls_and_nan_and_merge(spark):
    from furrow.operators import ridge
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 3)) * [1, 10, 1e-3] + [1e6, 0, 5]
    rows = [tuple(map(float, v)) for v in x] + [(None, 1.0, 2.0), (1.0, float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(7)
    n, mean, cov = ridge.central_moments(df, {c: F.col(c) for c in "abc"})
    assert n == 60 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, bias=True))
    n, mean, cov = ridge.central_moments(df.limit(0), {c: F.col(c) for c in "abc"})
    assert n == 0 and not mean.any() and not cov.any()


def test_test_rows_come_from_the_cached_table(spark, sf):
    from furrow.plans import q_models
    for split in (q_models.crop_split, q_models.fert_split, q_models.yield_split):
        assert "InMemoryTableScan" in split(spark, sf)[1]._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("cells", [0, 40, 1 << 21])
def test_shapley_by_tables_and_walks_equals_all_subsets(spark, monkeypatch, cells):
    """The expectations of small and of large subsets, by table and by walk, in whatever proportion; groups of trees add up."""
    from furrow.operators import explain
    r = np.random.default_rng(9)
    rows = [(i, *(float(v) for v in r.integers(0, 9, 3)), f"k{r.integers(0, 6)}", f"c{int(r.integers(0, 3))}") for i in range(300)]
    df = spark.createDataFrame(rows, "obs_id long, a double, b double, d double, k string, y string")
    m = models.fit_pipeline(df, ["a", "b", "d"], ["k"], "y", models.classifier("random_forest", 4, num_trees=5, max_depth=7))
    trees = explain.forest_tables(spark, m.stages[-1])
    x = np.array([v.x for v in m.transform(df).select(vector_to_array("raw").alias("x")).collect()])
    x = np.concatenate([x] * 40)  # enough rows for the tables to be worth their while
    monkeypatch.setattr(explain, "CELLS", cells)
    calls, direct = [], explain.shapley
    monkeypatch.setattr(explain, "shapley", lambda *a: calls.append(1) or direct(*a))
    whole = explain.leaf_table(trees, 4)
    for size in (whole.nbytes, whole.nbytes // 3):
        groups = list(explain.subforests(trees, 4, size))
        assert len(groups) == (1 if size == whole.nbytes else 5)
        for c in range(3):
            parts = [g.shapley(x, c) for g in groups]
            phi, base, prob = (sum(p[i] for p in parts) for i in range(3))
            want = direct(whole, x[:300], np.full(300, c))
            assert np.allclose(phi, np.concatenate([want[0]] * 40), atol=1e-12)
            assert np.allclose(base[:300], want[1], atol=1e-12) and np.allclose(prob[:300], want[2], atol=1e-12)
    assert not calls
    assert np.allclose(direct(whole, x[:20], np.full(20, 1))[0], subsets_by_brute_force(trees, x[:20], np.full(20, 1)), atol=1e-10)


def test_yield_forest_is_the_whole_forest():
    """100 trees without a depth limit, as the reference's."""
    est = models.regressor("random_forest")
    assert (est.getNumTrees(), est.getMaxDepth()) == (100, models.UNLIMITED_DEPTH)


def test_fit_rf_regressor_takes_the_whole_forest(spark, monkeypatch):
    seen = []

    class Seen(Exception):
        pass

    def fit(train, numeric, categorical, label, estimator):
        seen.append((estimator.getNumTrees(), estimator.getMaxDepth()))
        raise Seen

    monkeypatch.setattr(models, "fit_pipeline", fit)
    monkeypatch.setattr(q_models, "yield_split", lambda *a: (None, None))
    with pytest.raises(Seen):
        q_models.fit_rf_regressor(spark, "")
    assert seen == [(100, models.UNLIMITED_DEPTH)]
