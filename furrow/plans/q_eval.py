"""Queries: evaluation aggregates, leaderboards, per-row ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import encode, evaluate, ranking
from furrow.plans.registry import register
from furrow.plans.sqlfrag import Raw, h32, with_views
from furrow.sources import fixtures as fx

CHOSEN_MODEL = "rule_jitter15"


@register("accuracy", with_views("preds_cls") + """
SELECT model, round(avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END) * 100, 2) AS accuracy FROM preds_cls GROUP BY model""",
          ops="F1")
def accuracy(spark, sf):
    return evaluate.accuracy(fx.preds_cls(spark, sf), ["model"])


@register("confusion_matrix", with_views("preds_cls") + """
SELECT model, y, yhat, count(*) AS n FROM preds_cls GROUP BY model, y, yhat""", ops="F3")
def confusion_matrix(spark, sf):
    return evaluate.confusion(fx.preds_cls(spark, sf), ["model"])


_REPORT_SQL = with_views("preds_cls") + """
, cm AS (SELECT model, y, yhat, count(*) AS n FROM preds_cls GROUP BY model, y, yhat),
bt AS (SELECT model, y AS label, sum(n) AS support, sum(CASE WHEN y = yhat THEN n ELSE 0 END) AS tp FROM cm GROUP BY model, y),
bp AS (SELECT model, yhat AS label, sum(n) AS predicted FROM cm GROUP BY model, yhat),
per0 AS (SELECT coalesce(bt.model, bp.model) AS model, coalesce(bt.label, bp.label) AS label,
  coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted
  FROM bt FULL OUTER JOIN bp ON bt.model = bp.model AND bt.label = bp.label),
per1 AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM per0),
per AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM per1),
tot AS (SELECT model, sum(support) AS total, sum(tp) AS correct, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
  sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM per GROUP BY model)
SELECT model, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM per
UNION ALL SELECT model, 'accuracy', round(correct / total, 6), round(correct / total, 6), round(correct / total, 6), total FROM tot
UNION ALL SELECT model, 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), total FROM tot
UNION ALL SELECT model, 'weighted avg', round(wp / total, 6), round(wr / total, 6), round(wf / total, 6), total FROM tot"""


@register("classification_report", _REPORT_SQL, ops="F2")
def classification_report(spark, sf):
    return evaluate.classification_report(fx.preds_cls(spark, sf), ["model"])


@register("regression_metrics", with_views("preds_reg") + """
SELECT Crop, round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 4) AS R2,
  round(sqrt(avg((y - yhat) * (y - yhat))), 4) AS RMSE, round(avg(abs(y - yhat)), 4) AS MAE FROM preds_reg GROUP BY Crop""",
          ops="F4")
def regression_metrics(spark, sf):
    return evaluate.regression_metrics(fx.preds_reg(spark, sf), ["Crop"])


def _folded(spark, sf):
    p = fx.preds_cls_wide(spark, sf)
    folds = encode.kfold_assign(fx.obs(spark, sf).select("obs_id", F.col("Fertilizer").alias("label")),
                                "label", "obs_id", 5)
    # one row an observation is shuffled, not one a model
    return fx.preds_long(p.join(folds.select("obs_id", "fold"), "obs_id"))


@register("cv_summary", with_views("preds_cls", "obs") + f"""
, f AS (SELECT obs_id, (row_number() OVER (PARTITION BY Fertilizer ORDER BY {h32('fold', 42, Raw('obs_id'))}, obs_id) - 1) % 5 AS fold FROM obs),
s AS (SELECT model, fold, avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END) * 100 AS acc FROM preds_cls JOIN f USING (obs_id) GROUP BY model, fold)
SELECT model, round(avg(acc), 6) AS cv_mean, round(stddev_pop(acc), 6) AS cv_std, count(*) AS n_folds FROM s GROUP BY model""",
          ops="F5 G6")
def cv_summary(spark, sf):
    fold_acc = evaluate.accuracy(_folded(spark, sf), ["model", "fold"], out="acc", decimals=None)
    return evaluate.cv_summary(fold_acc, ["model"], "acc")


_ACC_SQL = "(SELECT model, round(avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END) * 100, 2) AS accuracy FROM preds_cls GROUP BY model)"


@register("leaderboard", with_views("preds_cls") + f"""
SELECT model, accuracy, row_number() OVER (ORDER BY accuracy DESC, model) AS rank,
       accuracy = max(accuracy) OVER () AS is_best FROM {_ACC_SQL} a""", ops="F6 H6 H9")
def leaderboard(spark, sf):
    return evaluate.leaderboard(evaluate.accuracy(fx.preds_cls(spark, sf), ["model"]), [], "model", "accuracy")


@register("best_model", with_views("preds_cls") + f"""
SELECT arg_min(model, struct_pack(s := -accuracy, m := model)) AS best_model, max(accuracy) AS best_score FROM {_ACC_SQL} a""",
          ops="E16 H10")
def best_model(spark, sf):
    return evaluate.best_model(evaluate.accuracy(fx.preds_cls(spark, sf), ["model"]), [], "model", "accuracy")


@register("model_gap", with_views("preds_cls") + f"""
SELECT max(accuracy) AS best_score, max(CASE WHEN model = '{CHOSEN_MODEL}' THEN accuracy END) AS chosen_score,
  round(max(accuracy) - coalesce(max(CASE WHEN model = '{CHOSEN_MODEL}' THEN accuracy END), 0.0), 2) AS gap,
  CASE WHEN round(max(accuracy) - coalesce(max(CASE WHEN model = '{CHOSEN_MODEL}' THEN accuracy END), 0.0), 2) < 1
       THEN 'within margin' ELSE 'notable gap' END AS verdict FROM {_ACC_SQL} a""", ops="E17 J15")
def model_gap(spark, sf):
    return evaluate.model_gap(evaluate.accuracy(fx.preds_cls(spark, sf), ["model"]), [], "model", "accuracy",
                              CHOSEN_MODEL)


@register("top3_classes", with_views("probs") + """
, u AS (SELECT row_id, unnest(probability) AS p, unnest(generate_series(0, len(probability) - 1)) AS cls FROM probs),
r AS (SELECT row_id, cls, p, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, cls) AS rk FROM u)
SELECT row_id, max(CASE WHEN rk = 1 THEN cls END) AS pred, round(max(CASE WHEN rk = 1 THEN p END) * 100, 6) AS confidence,
  max(CASE WHEN rk = 1 THEN cls END) AS c1, round(max(CASE WHEN rk = 1 THEN p END) * 100, 6) AS p1,
  max(CASE WHEN rk = 2 THEN cls END) AS c2, round(max(CASE WHEN rk = 2 THEN p END) * 100, 6) AS p2,
  max(CASE WHEN rk = 3 THEN cls END) AS c3, round(max(CASE WHEN rk = 3 THEN p END) * 100, 6) AS p3
FROM r GROUP BY row_id""", ops="H1 H2 J10")
def top3_classes(spark, sf):
    p = fx.probs(spark, sf)
    pred, conf = ranking.argmax_confidence(F.col("probability"))
    t = p.select("row_id", pred.alias("pred"), F.round(conf, 6).alias("confidence"),
                 ranking.top_classes(F.col("probability"), 3).alias("top"))
    cols = []
    for i in range(3):
        cols += [F.col("top")[i]["cls"].cast("bigint").alias(f"c{i + 1}"),
                 F.round(F.col("top")[i]["p"] * 100, 6).alias(f"p{i + 1}")]
    return t.select("row_id", F.col("pred").cast("bigint").alias("pred"), "confidence", *cols)


@register("zip_explode", with_views("probs") + """
SELECT row_id, CAST(unnest(generate_series(0, len(probability) - 1)) AS INTEGER) AS pos,
       'class_' || CAST(unnest(generate_series(0, len(probability) - 1)) AS VARCHAR) AS cls,
       round(unnest(probability), 6) AS p FROM probs""", ops="D8")
def zip_explode(spark, sf):
    p = fx.probs(spark, sf)
    names = F.transform(F.col("probability"), lambda v, i: F.concat(F.lit("class_"), i.cast("string")))
    z = p.select("row_id", F.posexplode(F.arrays_zip(names.alias("cls"), F.col("probability").alias("p"))))
    return z.select("row_id", F.col("pos").cast("int").alias("pos"), F.col("col.cls").alias("cls"),
                    F.round(F.col("col.p"), 6).alias("p"))


@register("explain_topk", with_views("contribs") + """
SELECT obs_id, sign, rank, feature, contribution FROM (
  SELECT obs_id, feature, contribution, CASE WHEN contribution > 0 THEN 'positive' ELSE 'negative' END AS sign,
    row_number() OVER (PARTITION BY obs_id, contribution > 0 ORDER BY abs(contribution) DESC, feature) AS rank
  FROM contribs WHERE contribution <> 0) z
WHERE (sign = 'positive' AND rank <= 3) OR (sign = 'negative' AND rank <= 2)""", ops="H4 H5 B7")
def explain_topk(spark, sf):
    t = ranking.top_contributions(fx.contribs(spark, sf), "obs_id")
    return t.select("obs_id", "sign", F.col("rank").cast("bigint").alias("rank"), "feature", "contribution")
