"""Queries: model fits, comparison, CV, tuning, importance, scoring, persistence.

Model outputs cannot be written in SQL, so all but `ridge_gram` have no oracle; their
properties are unit-tested (tests/test_models.py).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import rules
from furrow.operators import boosting, clean, encode, evaluate, kernelsvm, models, ranking, ridge
from furrow.operators.barrier import barrier
from furrow.plans.registry import register
from furrow.plans.sqlfrag import with_views
from furrow.session import scratch_path
from furrow.sources import fixtures as fx

YIELD_NUMERIC = ["Temperature", "Humidity", "Soil_Moisture", "Area", "Crop_Year"]
YIELD_CATEGORICAL = ["Crop", "Season", "State_Name"]
FERT_NUMERIC = ["Temperature", "Humidity", "Rainfall", "pH", "N", "P", "K"]
FERT_CATEGORICAL = ["Soil", "Crop"]


def _halves(s):
    """(training rows, test rows) of one cached table: the test rows are not derived a second time."""
    s = s.cache()
    return s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")


def crop_split(spark, sf):
    return _halves(encode.stratified_split(fx.obs(spark, sf), "Crop", "obs_id"))


def fert_split(spark, sf):
    return _halves(encode.stratified_split(fx.obs(spark, sf), "Fertilizer", "obs_id"))


def yield_split(spark, sf):
    y = clean.trim_upper_quantile(clean.yield_clean(fx.yield_raw(spark, sf)), "yield_per_hectare", 0.99,
                                  key_col="rec_id")
    # the null test must not be pushed below the joins, where it would derive the hashed features a second time
    y = clean.drop_null_rows(barrier(y), fx.YIELD_FEATURES).withColumnRenamed("yield_per_hectare", "y")
    return _halves(encode.hash_split(y, "rec_id"))


def _acc_row(spark, task, name, preds):
    a = evaluate.accuracy(preds.withColumn("_t", F.lit(task)), ["_t"], "label_idx", "prediction")
    return a.select(F.col("_t").alias("task"), F.lit(name).alias("model"), "accuracy")


@register("fit_rf_classifier", None, ops="J3 G3 G4 F1")
def fit_rf_classifier(spark, sf):
    tr, te = crop_split(spark, sf)
    m = models.fit_pipeline(tr, fx.CROP_FEATURES, [], "Crop", models.classifier("random_forest", 7))
    return _acc_row(spark, "crop", "random_forest", m.transform(te))


def _raw(n: int) -> list:
    """The assembled features as columns."""
    x = vector_to_array("raw")
    return [x[i] for i in range(n)]


@register("fit_ridge", None, ops="J1 J2 C5 F4")
def fit_ridge(spark, sf):
    """Closed-form ridge on label codes (rounded half-even, clipped) and on yield."""
    tr, te = crop_split(spark, sf)
    prep = models.fit_features(tr, fx.CROP_FEATURES, [], "Crop")
    xs = _raw(len(fx.CROP_FEATURES))
    m = ridge.fit(prep.transform(tr), xs, F.col("label_idx"))
    preds = prep.transform(te).withColumn("prediction", rules.round_clip_class(m.predict(xs), 22).cast("double"))
    cls = _acc_row(spark, "crop", "ridge", preds) \
        .select("task", "model", F.col("accuracy").alias("score"), F.lit("accuracy").alias("metric"))
    ytr, yte = yield_split(spark, sf)
    yprep = models.fit_features(ytr, YIELD_NUMERIC, YIELD_CATEGORICAL, None)
    yxs = _raw(len(YIELD_NUMERIC) + len(YIELD_CATEGORICAL))
    ym = ridge.fit(yprep.transform(ytr), yxs, F.col("y"))
    met = evaluate.regression_metrics(yprep.transform(yte).withColumn("prediction", ym.predict(yxs)).withColumn("_t", F.lit("yield")),
                                      ["_t"], "y", "prediction")
    reg = met.select(F.col("_t").alias("task"), F.lit("ridge").alias("model"),
                     F.inline(F.array(*[F.struct(F.col(c).alias("score"), F.lit(c).alias("metric"))
                                        for c in ("R2", "RMSE", "MAE")])))
    return cls.unionByName(reg)


_GRAM = [*fx.CROP_FEATURES, "code"]


@register("ridge_gram", with_views("obs") + ", c AS (SELECT *, dense_rank() OVER (ORDER BY Crop) - 1 AS code FROM obs) " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(covar_pop({a}, {b}), 6) AS covariance FROM c" for a in _GRAM for b in _GRAM),
    ops="J1 J2")
def ridge_gram(spark, sf):
    """The one-pass moments behind the closed form: features and label code of the crop observations."""
    o = fx.obs(spark, sf)
    coded = StringIndexer(inputCol="Crop", outputCol="code", stringOrderType="alphabetAsc").fit(o).transform(o)
    return ridge.gram(coded, {c: F.col(c) for c in _GRAM})


#: The reference's schedules: crop A; fertilizer B and C.
CROP_BOOSTERS = [boosting.Booster("boosted_a", 200, 0.1, 6)]
FERT_BOOSTERS = [boosting.Booster("boosted_b", 300, 0.05, 6), boosting.Booster("boosted_c", 200, 0.05, 4, l2=0.0)]
YIELD_BOOSTERS = [boosting.Booster("boosted_a", 200, 0.1, 6), boosting.Booster("boosted_b", 200, 0.05, 5, l2=0.0)]


def fit_boosters(split, numeric, categorical, label, boosters):
    """(models, prepared test rows): all schedules of one task in the same passes over its training rows."""
    tr, te = split
    prep = models.fit_features(tr, numeric, categorical, label)
    classes = len(prep.stages[0].labels) if label else 0
    fitted = boosting.fit(prep.transform(tr), vector_to_array("raw"), F.col("label_idx" if label else "y"), boosters, classes)
    return fitted or [], prep.transform(te)


def _losses(m) -> list:
    """Training loss before the first and after the last iteration, and whether every iteration lowered it."""
    falls = all(b < a for a, b in zip(m.losses, m.losses[1:]))
    return [F.lit(m.booster.iterations).alias("iterations"), F.lit(round(m.losses[0], 6)).alias("first_loss"),
            F.lit(round(m.losses[-1], 6)).alias("last_loss"), F.lit(falls).alias("loss_falls")]


@register("fit_gbt_multiclass", None, ops="J5 J6 J7")
def fit_gbt_multiclass(spark, sf):
    """The three boosted classifiers at their full schedules; the two tasks are fitted side by side."""
    tasks = [("crop", crop_split(spark, sf), fx.CROP_FEATURES, [], "Crop", CROP_BOOSTERS),
             ("fertilizer", fert_split(spark, sf), FERT_NUMERIC, FERT_CATEGORICAL, "Fertilizer", FERT_BOOSTERS)]
    with ThreadPoolExecutor(len(tasks)) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(lambda t: (t[0], *fit_boosters(*t[1:]))), tasks))
    x = vector_to_array("raw")
    best = ranking.argmax_confidence(F.col("boosted"))[0].cast("double")
    rows = [_acc_row(spark, task, m.booster.name, te.withColumn("boosted", m.predict(x)).withColumn("prediction", best))
            .select("*", *_losses(m)) for task, fitted, te in done for m in fitted]
    return reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame(
        [], "task string, model string, accuracy double, iterations int, first_loss double, last_loss double, loss_falls boolean")


def fit_kernel(split, numeric, categorical, label):
    """(model, prepared test rows with margins, probabilities, prediction) of one task."""
    tr, te = split
    prep = models.fit_features(tr, numeric, categorical, label)
    t = prep.transform(tr)
    x = vector_to_array("features")
    m = kernelsvm.fit(t, x, F.col("label_idx"), len(prep.stages[0].labels), models.gamma_scale(t, len(numeric) + len(categorical)))
    if m is None:
        return None, None
    p = prep.transform(te).withColumn("margins", m.margins(x)).withColumn("probability", m.probabilities(F.col("margins")))
    best, sure = ranking.argmax_confidence(F.col("margins"))[0], F.array_max("probability")
    return m, p.withColumn("prediction", best.cast("double")).withColumn("confidence", sure)


@register("fit_rff_svm", None, ops="J9 J10")
def fit_rff_svm(spark, sf):
    """The kernel classifier on both tasks: accuracy, calibration error, and whether probabilities add up to one and rank as the margins."""
    rows = []
    for task, split, numeric, categorical, label in [
            ("crop", crop_split(spark, sf), fx.CROP_FEATURES, [], "Crop"),
            ("fertilizer", fert_split(spark, sf), FERT_NUMERIC, FERT_CATEGORICAL, "Fertilizer")]:
        m, p = fit_kernel(split, numeric, categorical, label)
        if m is None:
            continue
        total = F.aggregate("probability", F.lit(0.0), lambda a, v: a + v)
        best = F.element_at("probability", F.col("prediction").cast("int") + 1)
        checks = p.groupBy(F.lit(task).alias("task")).agg(F.every(F.abs(total - 1) < 1e-9).alias("sums_to_one"),
                                                          F.every(best == F.col("confidence")).alias("ranks_as_margins"))
        ece = evaluate.calibration_error(p, F.col("confidence"), F.col("prediction") == F.col("label_idx"))
        rows.append(_acc_row(spark, task, "rff_svm", p).select("*", F.lit(m.passes).alias("passes"),
                                                               F.lit(len(m.phase)).alias("components"))
                    .join(ece.withColumn("task", F.lit(task)), "task").join(checks, "task"))  # one row each
    return reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame(
        [], "task string, model string, accuracy double, passes int, components int, calibration_error double, sums_to_one boolean, "
            "ranks_as_margins boolean")


def _reg_rows(name, model, te):
    met = evaluate.regression_metrics(model.transform(te).withColumn("_t", F.lit("yield")), ["_t"], "y", "prediction")
    return met.select(F.col("_t").alias("task"), F.lit(name).alias("model"), "R2", "RMSE", "MAE")


@register("fit_rf_regressor", None, ops="J4 F4")
def fit_rf_regressor(spark, sf):
    tr, te = yield_split(spark, sf)
    m = models.fit_pipeline(tr, YIELD_NUMERIC, YIELD_CATEGORICAL, None, models.regressor("random_forest"))
    return _reg_rows("random_forest", m, te)


@register("fit_gbt_regressor", None, ops="J8 F4")
def fit_gbt_regressor(spark, sf):
    """Both boosted regressors at their full schedules, in the same passes."""
    fitted, te = fit_boosters(yield_split(spark, sf), YIELD_NUMERIC, YIELD_CATEGORICAL, None, YIELD_BOOSTERS)
    rows = [evaluate.regression_metrics(te.withColumn("prediction", m.predict(vector_to_array("raw"))[0]).withColumn("_t", F.lit("yield")),
                                        ["_t"], "y", "prediction")
            .select(F.col("_t").alias("task"), F.lit(m.booster.name).alias("model"), "R2", "RMSE", "MAE", *_losses(m)) for m in fitted]
    return reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame(
        [], "task string, model string, R2 double, RMSE double, MAE double, iterations int, first_loss double, last_loss double, "
            "loss_falls boolean")


def _folded(spark, sf, k):
    """The prepared crop observations with their fold."""
    o = fx.obs(spark, sf)
    folded = encode.kfold_assign(o, "Crop", "obs_id", k).cache()
    from pyspark.ml import Pipeline
    prep = Pipeline(stages=models.feature_pipeline(fx.CROP_FEATURES, [], "Crop", scale=False)).fit(folded)
    return prep.transform(folded).cache()


def _cv(spark, sf, grid_fn, k):
    data = _folded(spark, sf, k)
    rf = models.classifier("random_forest", 7, num_trees=20, max_depth=20)
    ev = MulticlassClassificationEvaluator(labelCol="label_idx", predictionCol="prediction", metricName="accuracy")
    grid = grid_fn(rf)
    cv = CrossValidator(estimator=rf, estimatorParamMaps=grid, evaluator=ev, foldCol="fold", numFolds=k,
                        parallelism=4, seed=42)
    return cv.fit(data), grid


@register("cv_models", None, ops="J11 F5")
def cv_models(spark, sf):
    """5-fold stratified cross-validation: mean and population std of fold accuracy."""
    cvm, grid = _cv(spark, sf, lambda rf: ParamGridBuilder().addGrid(rf.numTrees, [20]).build(), 5)
    import math
    mean, std = cvm.avgMetrics[0], cvm.stdMetrics[0]
    n = 5
    std_pop = std * math.sqrt((n - 1) / n)  # Spark reports the sample std of fold scores
    return spark.range(1).select(F.lit("random_forest").alias("model"), F.round(F.lit(mean * 100), 4).alias("cv_mean"),
                                 F.round(F.lit(std_pop * 100), 4).alias("cv_std"))


#: The reference's grid: trees, depth (none, 10, 20), and least rows of a split as least rows of a child.
TUNE_TREES, TUNE_DEPTHS, TUNE_MIN_INSTANCES, TUNE_FOLDS = [100, 200], [models.UNLIMITED_DEPTH, 10, 20], [1, 2], 3


def fold_accuracies(train, test, min_instances, trees, depths):
    """{(trees, depth): share of ``test`` that the forest gets right}. The first trees of a forest are the forest of so many trees, and its
    upper levels the trees of a lower depth limit, so one forest is grown for all of them."""
    est = models.classifier("random_forest", 7, num_trees=max(trees), max_depth=max(depths), min_instances=min_instances)
    est.whole = True
    grown = est.fit(train)
    out = {}
    for depth in depths:
        at = grown.limited(depth).scored(vector_to_array("raw"), trees)["at"]
        right = [F.avg((F.col("_at")[i] == F.col("label_idx")).cast("double")) for i in range(len(trees))]
        got = test.select("label_idx", at.alias("_at")).agg(*[r.alias(f"t{n}") for r, n in zip(right, trees)]).first()
        out |= {(n, depth): got[f"t{n}"] for n in trees}
    return out


def tune(data, folds, trees, depths, min_instances):
    """[(trees, depth, min instances, mean accuracy over the folds)] of all grid points, in the order of a nested loop."""
    found = {}
    todo = [(k, m) for m in min_instances for k in range(folds)]
    with ThreadPoolExecutor(2) as pool:  # two forests at a time keep the cores busy between the levels
        one = inheritable_thread_target(data.sparkSession)(
            lambda t: fold_accuracies(data.where(F.col("fold") != t[0]), data.where(F.col("fold") == t[0]), t[1], trees, depths))
        for (_, m), acc in zip(todo, pool.map(one, todo)):
            for (n, depth), v in acc.items():
                found.setdefault((n, depth, m), []).append(v)
    return [(n, depth, m, sum(found[n, depth, m]) / folds) for n in trees for depth in depths for m in min_instances]


@register("tune_rf", None, ops="J12")
def tune_rf(spark, sf):
    """Grid search (trees x depth x min instances) with 3 stratified folds; all grid points reported, the best is refitted on all rows."""
    data = _folded(spark, sf, TUNE_FOLDS)
    rows = tune(data, TUNE_FOLDS, TUNE_TREES, TUNE_DEPTHS, TUNE_MIN_INSTANCES)
    best = max(rows, key=lambda r: (r[3], -r[0], -r[1], -r[2]))
    models.classifier("random_forest", 7, num_trees=best[0], max_depth=best[1], min_instances=best[2]).fit(data)
    df = spark.createDataFrame(rows, "num_trees int, max_depth int, min_instances int, cv_accuracy double")
    return df.withColumn("is_best", (F.col("num_trees") == best[0]) & (F.col("max_depth") == best[1])
                         & (F.col("min_instances") == best[2]))


@register("feature_importance", None, ops="J13")
def feature_importance(spark, sf):
    tr, _ = crop_split(spark, sf)
    m = models.fit_pipeline(tr, fx.CROP_FEATURES, [], "Crop", models.classifier("random_forest", 7))
    imp = models.feature_importance(m.stages[-1], fx.CROP_FEATURES)
    df = spark.createDataFrame(imp, "feature string, importance double")
    return evaluate.leaderboard(df, [], "feature", "importance")


def crop_scorer(spark, sf, num_trees=100):
    tr, _ = crop_split(spark, sf)
    return models.fit_pipeline(tr, fx.CROP_FEATURES, [], "Crop",
                               models.classifier("random_forest", 7, num_trees=num_trees))


def score_records(model, records):
    """Predicted crop, confidence and top-3 alternatives for any number of records."""
    labels = model.stages[0].labels
    p = model.transform(records).withColumn("_p", vector_to_array("probability"))
    pred, conf = ranking.argmax_confidence(F.col("_p"))
    top = ranking.top_classes(F.col("_p"), 3)
    names = F.array(*[F.lit(x) for x in labels])
    top_txt = F.array_join(F.transform(top, lambda s: F.format_string(
        "%s (%.1f%%)", F.element_at(names, s["cls"] + 1), s["p"] * 100)), ", ")
    dec = IndexToString(inputCol="prediction", outputCol="predicted", labels=labels)
    return dec.transform(p).select("obs_id", F.upper("predicted").alias("predicted"),
                                   F.round(conf, 1).alias("confidence"), top_txt.alias("top3"))


@register("score_batch", None, ops="J16 J10 H1 H2 D2")
def score_batch(spark, sf):
    """Score every observation with the crop forest."""
    return score_records(crop_scorer(spark, sf), fx.obs(spark, sf))


@register("score_fertilizer", None, ops="J16 J10 J3 H1 H2 D2")
def score_fertilizer(spark, sf):
    """Score every observation with the fertilizer forest: decoded class, confidence and top 3."""
    tr, _ = fert_split(spark, sf)
    m = models.fit_pipeline(tr, FERT_NUMERIC, FERT_CATEGORICAL, "Fertilizer", models.classifier("random_forest", 9))
    return score_records(m, fx.obs(spark, sf))


def score_yield_records(model, records):
    """Clamped yield per hectare, total over the area, and rating for any number of records."""
    pred = rules.non_negative(F.col("prediction"))
    return model.transform(records).select(
        "rec_id", F.round(pred, 6).alias("predicted"), F.round(pred * F.col("Area"), 6).alias("total"),
        rules.yield_rating(pred).alias("rating"))


@register("score_yield", None, ops="J16 J4 C6 C7 C8")
def score_yield(spark, sf):
    """Score every field record with the yield forest; records without a feature are left out as in training."""
    tr, _ = yield_split(spark, sf)
    m = models.fit_pipeline(tr, YIELD_NUMERIC, YIELD_CATEGORICAL, None, models.regressor("random_forest"))
    return score_yield_records(m, clean.drop_null_rows(fx.yield_raw(spark, sf), fx.YIELD_FEATURES))


@register("model_roundtrip", None, ops="A7 A8")
def model_roundtrip(spark, sf):
    """Save the fitted pipeline (indexers + model), load it, and compare predictions row by row."""
    from pyspark.ml import PipelineModel
    m = crop_scorer(spark, sf)
    path = scratch_path(spark, "model")
    m.write().overwrite().save(path)
    m2 = PipelineModel.load(path)
    o = fx.obs(spark, sf)
    a = m.transform(o).select("obs_id", F.col("prediction").alias("p1"))
    b = m2.transform(o).select("obs_id", F.col("prediction").alias("p2"))
    return a.join(b, "obs_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.sum((F.col("p1") == F.col("p2")).cast("long")).alias("n_equal"))


@register("explain_rows", None, ops="J14 H4 H5 B7")
def explain_rows(spark, sf):
    """Exact Shapley contributions of the deployed crop forest for every observation's predicted class: the top three positive and
    top two negative by absolute value, chosen within the row."""
    from furrow.operators import explain
    return explain.explain_top(spark, crop_scorer(spark, sf), fx.obs(spark, sf), "obs_id", fx.CROP_FEATURES)
