"""Document store build/load, category counts and training-curve shaping."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.ordering import indexed


def with_batches(df: DataFrame, key: str, batch_size: int = 10) -> DataFrame:
    """Batch number = position in key order // batch_size (positions without a global window)."""
    return indexed(df, [key], idx_col="_pos").withColumn(
        "batch", F.floor(F.col("_pos") / batch_size).cast("long")).drop("_pos")


def build_store(docs: DataFrame, path: str, batch_size: int = 10) -> None:
    """Replace the store at ``path`` (overwrite), partitioned by category."""
    with_batches(docs, "id", batch_size).write.mode("overwrite").partitionBy("category").parquet(path)


def load_store(spark: SparkSession, path: str) -> tuple[DataFrame | None, bool]:
    """(store, loaded): a missing or empty store is 'not loaded'."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:  # only a missing or empty folder is a normal state
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None, False
    if df.isEmpty():
        return None, False
    return df, True


def category_counts(docs: DataFrame, col: str = "category") -> DataFrame:
    """Documents per category plus a total row (category NULL) via ROLLUP."""
    return docs.rollup(col).agg(F.count(F.lit(1)).alias("n_docs"))


def training_curve(log: DataFrame, run: str = "run", order: str = "event_id", error: str = "error",
                   ts: str = "ts") -> DataFrame:
    """Iteration number, previous error (lag), improvement and time per iteration.

    Iterations come from ``indexed`` (no per-run single-task window); the
    previous iteration is found by an equi-join on (run, iteration - 1).
    """
    it = indexed(log, [order], [run]).withColumn("iteration", F.col("_idx") + 1).drop("_idx")
    prev = it.select(F.col(run).alias("_r"), (F.col("iteration") + 1).alias("_it"),
                     F.col(error).alias("prev_error"), F.col(ts).alias("_pts"))
    j = it.join(prev, (it[run] == prev["_r"]) & (it["iteration"] == prev["_it"]), "left")
    return j.select(run, "iteration", error, "prev_error",
                    (F.col("prev_error") - F.col(error)).alias("improvement"),
                    (F.timestamp_diff("MICROSECOND", F.col("_pts"), F.col(ts)) / 1000.0).alias("ms_since_prev"))
