"""Forests grown from histograms: same forest as Spark ML's, few jobs, the same trees wherever the upper part ends."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from furrow.operators import forest, models


@pytest.fixture(scope="module")
def rows(spark):
    """Noisy classes and a target over two numbers and a category whose codes are in no useful order; some rows occur twice."""
    h = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 1000
    t = spark.range(3000).select("id", h("a").alias("a"), h("b").alias("b"),
                                 F.element_at(F.array(*[F.lit(c) for c in "qwerty"]), (h("k") * 6).cast("int") + 1).alias("kind"), h("n").alias("noise"))
    c = F.when(F.col("noise") < 0.15, F.floor(F.col("noise") * 20)).otherwise((F.col("a") > 0.5).cast("int") + F.col("kind").isin("q", "t").cast("int"))
    t = t.withColumn("cls", F.concat(F.lit("c"), c.cast("string"))).withColumn("y", F.col("a") * 3 + F.when(F.col("kind").isin("w", "y"), 5).otherwise(0) + F.col("noise"))
    return t.unionByName(t.where("id % 10 = 0")).cache()


def test_forest_has_few_jobs_without_a_depth_limit(spark, rows):
    prep = models.fit_features(rows, ["a", "b"], ["kind"], "cls").transform(rows).cache()
    prep.count()
    spark.sparkContext.setJobGroup("forest", "fit")
    try:
        m = models.classifier("random_forest", 3, num_trees=5).fit(prep)
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert max(t.depth for t in m.trees) > 15
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest")) < 25  # Spark ML: more than two a level of this depth


def test_forest_classifies_as_spark_ml(rows):
    tr, te = rows.where("id % 5 <> 0"), rows.where("id % 5 = 0")
    est = models.classifier("random_forest", 3, num_trees=20, max_depth=8)
    stock = RandomForestClassifier(featuresCol="raw", labelCol="label_idx", numTrees=20, maxDepth=8, seed=1)
    found = []
    for e in (est, stock):
        m = models.fit_pipeline(tr, ["a", "b"], ["kind"], "cls", e)
        p = m.transform(te)
        total = F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda x, v: x + v)
        assert p.where(F.abs(total - 1) > 1e-9).count() == 0
        f = m.stages[-1]
        found.append((p.agg(F.avg((F.col("prediction") == F.col("label_idx")).cast("double"))).first()[0], f.featureImportances.toArray()))
        assert f.getNumTrees == 20 and f.numClasses == len(m.stages[0].labels)
    assert abs(found[0][0] - found[1][0]) < 0.04 and np.abs(found[0][1] - found[1][1]).max() < 0.1


def test_trees_do_not_depend_on_where_the_upper_part_ends(rows, monkeypatch):
    once = rows.dropDuplicates(["id"])  # copies in one block are drawn apart
    prep = models.fit_features(once, ["a", "b"], ["kind"], None).transform(once)
    seen = []
    for local, parts in ((10 ** 9, 1), (150, 7)):
        monkeypatch.setattr(forest, "LOCAL_ROWS", local)
        m = models.regressor("random_forest", num_trees=3, max_depth=9).fit(prep.repartition(parts))
        p = m.transform(prep).select("id", "prediction", "y").orderBy("id").toPandas()
        seen.append((p["prediction"].to_numpy(), m.totalNumNodes))
    assert np.abs(p["prediction"] - p["y"]).mean() < 0.3
    assert np.allclose(*[v for v, _ in seen]) and seen[0][1] == seen[1][1]


def test_split_of_a_node_is_the_best_of_all_cuts():
    rng = np.random.default_rng(3)
    x, y, w = rng.integers(0, 6, (80, 2)), rng.integers(0, 3, 80), rng.integers(1, 3, 80).astype(float)
    g = forest.Grower(1, 5, 3, [0, 0], [np.arange(5.0)] * 2, 6, 2, 1, 0.0, 42)
    node = np.zeros(80, dtype=np.int64)
    stats = g.totals(node, 1, y, w)
    f, gain, goes, low, high = g.best_splits(g.histogram(x, node, 1, g.features(1), y, w), g.features(1), g.impurity(stats))

    def gini(on):
        c = np.bincount(y[on], w[on], 3)
        return c.sum() * (1 - (c ** 2).sum() / c.sum() ** 2)

    every = {(j, c): (gini(x[:, j] < 9) - gini(x[:, j] <= c) - gini(x[:, j] > c)) / w.sum() for j in range(2) for c in range(5)}
    best = max(every, key=every.get)
    assert (f[0], goes[0].sum() - 1) == best and abs(gain[0] - every[best]) < 1e-12
    assert np.allclose(low + high, stats)


def test_a_number_with_few_values_can_be_cut_between_all_of_them(spark):
    """The least of 20 values holds half a percent of the rows, below the lowest of 32 quantiles."""
    t = spark.range(4000).select(F.when(F.col("id") % 200 == 0, 0.0).otherwise(F.col("id") % 19 + 1.0).alias("a"), "id")
    t = t.withColumn("y", F.when(F.col("a") == 0, 100.0).otherwise(0.0))
    prep = models.fit_features(t, ["a"], [], None).transform(t)
    m = models.regressor("random_forest", num_trees=3, max_depth=3, max_bins=32).fit(prep)
    assert m.transform(prep).where(F.abs(F.col("prediction") - F.col("y")) > 1e-9).count() == 0


def test_fitted_forest_stays_out_of_the_driver(spark, rows, monkeypatch, tmp_path):
    """Its nodes are no JVM objects; parts and groups of any size score the same, saved and loaded; a null scores null."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.util import JavaMLWritable

    from furrow.operators import forestmodel
    m = models.fit_pipeline(rows, ["a", "b"], ["kind"], "cls", models.classifier("random_forest", 3, num_trees=4))
    f = m.stages[-1]
    assert not isinstance(f, JavaMLWritable) and not hasattr(f, "_java_obj")
    want = m.transform(rows).select("id", "prediction", vector_to_array("probability").alias("p")).orderBy("id", "p").collect()
    assert sum(v.p[int(v.prediction)] == max(v.p) for v in want) == len(want)
    monkeypatch.setattr(forest, "LOCAL_ROWS", 150)
    monkeypatch.setattr(forestmodel, "PART_NODES", 50)
    monkeypatch.setattr(forestmodel, "GROUP_NODES", 200)
    monkeypatch.setattr(forestmodel, "CHUNK", 100)
    m = models.fit_pipeline(rows, ["a", "b"], ["kind"], "cls", models.classifier("random_forest", 3, num_trees=4))
    assert len(set(m.stages[-1].parts.values())) > 8 and len(m.stages[-1].groups()[0]) > 2
    trees = [t for _, t in m.stages[-1].nodes()]
    assert [len(t.left) for t in trees] == [t.numNodes for t in m.stages[-1].trees]
    m.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    a, b = (k.transform(rows).select("id", "prediction", vector_to_array("probability").alias("p")).orderBy("id", "p").collect() for k in (m, loaded))
    assert a == b and len(a) == len(want)
    x = m.transform(rows).where("id < 20").select("id", F.when(F.col("id") < 7, vector_to_array("raw")).alias("x"))
    got = x.select("id", m.stages[-1].scored(F.col("x"))["votes"].alias("v")).collect()
    assert all((r.v is None) == (r.id >= 7) for r in got)


def test_small_nodes_are_split_from_their_rows_as_from_histograms():
    rng = np.random.default_rng(5)
    for classes in (0, 2, 4):
        g = forest.Grower(1, 9, classes, [0, 5, 0], [np.arange(7.0), np.empty(0), np.arange(7.0)], 8, 2, 2, 0.0, 42, 3.0)
        node, m = rng.integers(0, 40, 600), 40
        x = np.stack([rng.integers(0, 8, 600), rng.integers(0, 5, 600), rng.integers(0, 8, 600)], axis=1)
        y, w = rng.integers(0, classes, 600) if classes else rng.normal(size=600), rng.integers(1, 4, 600).astype(np.uint8)
        feats, imp = g.features(m, 7), g.impurity(g.totals(node, m, y, w.astype(float)))
        want = g.best_splits(g.histogram(x, node, m, feats, y, w), feats, imp)
        got = g.few_splits(x, node, m, feats, y, w, imp)
        assert (want[0] == got[0]).all() and (want[1] == got[1]).all()
        on = want[0] >= 0
        seen = np.zeros((m, 5, 8), dtype=bool)  # categories that a node doesn't have may go either way
        seen[node, 0, x[:, 0]] = seen[node, 1, x[:, 1]] = seen[node, 2, x[:, 2]] = True
        held = seen[np.arange(m), np.maximum(want[0], 0)]
        assert on.sum() > 20 and ((want[2] == got[2]) | ~held)[on].all()


def test_weights_are_poisson_shares_of_the_hash():
    h = np.random.default_rng(1).integers(0, 2 ** 63, 200_000).astype(np.uint64)
    g = forest.Grower(1, 5, 2, [0], [np.arange(5.0)], 6, 1, 1, 0.0, 42)
    w = g.weights(h, 3)
    assert w.max() < 11 and np.abs(np.bincount(w, minlength=4)[:4] / len(w) - np.exp(-1) / np.array([1, 1, 2, 6])).max() < 0.005


def test_one_forest_serves_the_whole_grid(rows, monkeypatch):
    """The first trees, cut at a depth, are the forest that is fitted with so many trees and that depth."""
    from furrow.plans import q_models
    prep = models.fit_features(rows, ["a", "b"], ["kind"], "cls").transform(rows).withColumn("fold", (F.col("id") % 2).cast("int")).cache()
    monkeypatch.setattr(forest, "LOCAL_ROWS", 800)
    train, test = prep.where("fold <> 0"), prep.where("fold = 0")
    got = q_models.fold_accuracies(train, test, 1, [2, 4], [12, 3])
    for (n, depth), v in got.items():
        m = models.classifier("random_forest", 3, num_trees=n, max_depth=depth).fit(train)
        assert abs(v - m.transform(test).agg(F.avg((F.col("prediction") == F.col("label_idx")).cast("double"))).first()[0]) < 1e-12
    assert [r[:3] for r in q_models.tune(prep, 2, [2, 4], [3], [1, 2])] == [(2, 3, 1), (2, 3, 2), (4, 3, 1), (4, 3, 2)]
    assert (q_models.TUNE_TREES, sorted(q_models.TUNE_DEPTHS), q_models.TUNE_FOLDS) == ([100, 200], [10, 20, models.UNLIMITED_DEPTH], 3)
