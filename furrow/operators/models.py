"""Model training, comparison, tuning, scoring and persistence on Spark ML.

Tasks are tables + a feature list + a label. One ``Pipeline`` holds the
label/category indexers, the assembler and the scaler together with the
estimator, so the saved artefact cannot drift from its encoders.

Estimators (name -> Spark ML form):
  ridge          LinearRegression (L2); as a classifier its output is rounded
                 half-even and clipped to the class range
  random_forest  ForestClassifier / ForestRegressor (``forest``): Spark ML's forests, grown from histograms

Boosted trees are in ``boosting``, the kernel classifier in ``kernelsvm``; the Fourier map of the latter is here.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.rules import round_clip_class
from furrow.operators.forest import ForestClassifier, ForestRegressor

SEED = 42
#: Spark's deepest tree; stands for "no depth limit".
UNLIMITED_DEPTH = 30


def feature_pipeline(numeric: list[str], categorical: list[str], label: str | None,
                     scale: bool = True, n_rows: int | None = None) -> list:
    """Indexers (code-point order, like a sorted label encoder), assembler, scaler.

    Spark scales by the sample deviation; with the number of training rows the result is
    brought to the population deviation.
    """
    stages = []
    if label:
        stages.append(StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc"))
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_idx", stringOrderType="alphabetAsc",
                                    handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=numeric + [f"{c}_idx" for c in categorical], outputCol="raw",
                                  handleInvalid="error"))
    if scale:
        known = n_rows is not None and n_rows > 1
        stages.append(StandardScaler(inputCol="raw", outputCol="sample_scaled" if known else "features", withMean=True,
                                     withStd=True))
        if known:
            factor = [math.sqrt(n_rows / (n_rows - 1))] * (len(numeric) + len(categorical))
            stages.append(ElementwiseProduct(scalingVec=Vectors.dense(factor), inputCol="sample_scaled",
                                             outputCol="features"))
    return stages


def fit_features(train: DataFrame, numeric: list[str], categorical: list[str], label: str | None) -> PipelineModel:
    """The fitted feature stages, scaled by the population deviation of the training rows."""
    return Pipeline(stages=feature_pipeline(numeric, categorical, label, n_rows=train.count())).fit(train)


def bins_for(prep: PipelineModel, at_least: int, label: str | None) -> int:
    """Tree bins that hold every category of the fitted indexers, and the one kept for unseen values."""
    sizes = [len(s.labels) + 1 for s in prep.stages if isinstance(s, StringIndexerModel) and s.getInputCol() != label]
    return max([at_least, *sizes])


def with_bins(estimator, prep: PipelineModel, label: str | None):
    if estimator.hasParam("maxBins"):
        estimator.setMaxBins(bins_for(prep, estimator.getMaxBins(), label))
    return estimator


def rff_weights(dim: int, n_components: int, gamma: float, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """W ~ N(0, 2*gamma), b ~ U(0, 2*pi): a fixed, seeded parameter of size n_components x dim."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n_components, dim))
    b = rng.uniform(0.0, 2.0 * math.pi, size=n_components)
    return w, b


def rff_features(x: Column, dim: int, n_components: int, gamma: float, seed: int = SEED) -> Column:
    """sqrt(2/D) * cos(W x + b) as ARRAY<DOUBLE>; plain arithmetic per component (codegen friendly).

    ``x`` is an ARRAY<DOUBLE> of length ``dim``.
    """
    w, b = rff_weights(dim, n_components, gamma, seed)
    scale = math.sqrt(2.0 / n_components)
    comps = []
    for j in range(n_components):
        lin = F.lit(float(b[j]))
        for i in range(dim):
            lin = lin + x[i] * F.lit(float(w[j, i]))
        comps.append(F.cos(lin) * scale)
    return F.array(*comps)


def gamma_scale(df: DataFrame, n_features: int) -> float:
    """sklearn's gamma='scale' = 1 / (n_features * var(X)) over all scaled feature values (one small aggregate)."""
    v = df.select(F.explode(vector_to_array("features")).alias("v")).agg(F.var_pop("v")).first()[0]
    return 1.0 / (n_features * v) if v else 1.0


def classifier(name: str, n_features: int, **p):
    if name == "random_forest":
        return ForestClassifier(featuresCol="raw", labelCol="label_idx", numTrees=p.get("num_trees", 100),
                                maxDepth=p.get("max_depth", UNLIMITED_DEPTH), featureSubsetStrategy="sqrt",
                                minInstancesPerNode=p.get("min_instances", 1), impurity="gini",
                                maxBins=p.get("max_bins", 32), seed=SEED)
    raise ValueError(name)


def fit_pipeline(train: DataFrame, numeric: list[str], categorical: list[str], label: str, estimator) -> PipelineModel:
    prep = fit_features(train, numeric, categorical, label)
    model = with_bins(estimator, prep, label).fit(prep.transform(train))
    return PipelineModel(stages=[*prep.stages, model])


def ridge_penalty(t: DataFrame, label: str, alpha: float = 1.0) -> float:
    """``alpha * stddev_samp(label) / n``: makes Spark's scaled objective match the closed-form ridge solution."""
    st = t.agg(F.stddev_samp(label).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return alpha * (st["s"] or 1.0) / max(st["n"], 1)


def fit_ridge_classifier(train: DataFrame, numeric, categorical, label, alpha: float = 1.0):
    """Ridge regression on the label code; predictions are rounded half-even and clipped.

    ``regParam = alpha * std(y) / n`` makes Spark's scaled objective match the
    closed-form ridge solution (probed in the survey).
    """
    prep = fit_features(train, numeric, categorical, label)
    t = prep.transform(train)
    lr = LinearRegression(featuresCol="features", labelCol="label_idx", elasticNetParam=0.0,
                          regParam=ridge_penalty(t, "label_idx", alpha), standardization=False, solver="l-bfgs",
                          tol=1e-10, maxIter=500)
    model = lr.fit(t)
    return PipelineModel(stages=[prep, model])


def ridge_class_predictions(model: PipelineModel, df: DataFrame, n_classes: int) -> DataFrame:
    p = model.transform(df)
    return p.withColumn("prediction", round_clip_class(F.col("prediction"), n_classes).cast("double"))


def regressor(name: str, **p):
    if name == "ridge":
        return LinearRegression(featuresCol="features", labelCol="y", elasticNetParam=0.0,
                                regParam=p.get("reg", 1e-3), standardization=False, solver="l-bfgs", maxIter=200)
    if name == "random_forest":
        return ForestRegressor(featuresCol="raw", labelCol="y", numTrees=p.get("num_trees", 100),
                               maxDepth=p.get("max_depth", UNLIMITED_DEPTH), featureSubsetStrategy="all",
                               maxBins=p.get("max_bins", 64), seed=SEED)
    raise ValueError(name)


def feature_importance(model, names: list[str]) -> list[tuple[str, float]]:
    """(feature, importance) of a fitted tree model (normalised to sum 1 by Spark)."""
    imp = model.featureImportances.toArray()
    return [(n, float(v)) for n, v in zip(names, imp)]
