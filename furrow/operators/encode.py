"""Feature preparation: label codes, standardisation, splits and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.hashing import h32
from furrow.operators.joins import attach_small
from furrow.operators.ordering import indexed


def fit_label_codes(df: DataFrame, col: str, code_col: str = "code") -> DataFrame:
    """Vocabulary table (value, code): code = position of the value in code-point order.

    Distinct values first (partial+final aggregate), then positions from a
    range-partitioned sort, never a single-partition window.
    """
    d = df.select(F.col(col).cast("string").alias("value")).filter(F.col("value").isNotNull()).distinct()
    return indexed(d, ["value"], idx_col=code_col).select("value", F.col(code_col).cast("int").alias(code_col))


def encode(df: DataFrame, col: str, vocab: DataFrame, out: str | None = None, how: str = "left") -> DataFrame:
    """value -> code lookup; unknown values get NULL code (``how='left'``)."""
    out = out or f"{col}_code"
    v = vocab.select(F.col("value").alias("_v"), F.col("code").alias(out))
    j = attach_small(df.withColumn("_v", F.col(col).cast("string")), v, "_v", how)
    return j.drop("_v")


def decode(df: DataFrame, code_col: str, vocab: DataFrame, out: str) -> DataFrame:
    v = vocab.select(F.col("code").alias("_c"), F.col("value").alias(out))
    return attach_small(df.withColumn("_c", F.col(code_col)), v, "_c", "left").drop("_c")


def unknown_values(df: DataFrame, col: str, vocab: DataFrame) -> DataFrame:
    """Values of ``col`` missing from the vocabulary, with their row counts."""
    cand = df.select(F.col(col).alias("value")).filter(F.col("value").isNotNull())
    return cand.join(vocab.select("value"), "value", "left_anti").groupBy("value").agg(
        F.count(F.lit(1)).alias("n_rows"))


def standardize(df: DataFrame, cols: list[str], keys: list[str], decimals: int | None = 6) -> DataFrame:
    """(x - mean) / population std; a constant column gets scale 1.

    The statistics are one row (a global aggregate), so broadcasting them is safe.
    """
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(stats))
    outs = []
    for c in cols:
        scale = F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        z = (F.col(c) - F.col(f"_m_{c}")) / scale
        outs.append((F.round(z, decimals) if decimals is not None else z).alias(c))
    return j.select(*keys, *outs)


def split_key(seed: int, key_col: str):
    return h32("split", seed, F.col(key_col))


def stratified_split(df: DataFrame, label: str, key_col: str, test_frac: float = 0.2, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """Exact per-label proportions: within each label, rows in seeded hash order;
    the first round(frac * n_label) rows are 'test'. Hot labels are spread over
    many tasks by ``indexed``."""
    d = df.withColumn("_h", split_key(seed, key_col))
    pos = indexed(d, ["_h", key_col], [label])
    n = d.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    j = attach_small(pos, n, label)
    test = F.col("_idx") < F.round(F.col("_n") * F.lit(float(test_frac)))
    return j.withColumn(out, F.when(test, F.lit("test")).otherwise(F.lit("train"))).drop("_h", "_idx", "_n")


def hash_split(df: DataFrame, key_col: str, test_frac: float = 0.2, seed: int = 42, out: str = "split") -> DataFrame:
    """Unstratified split by hash bucket: a pure map, no shuffle."""
    pct = int(round(test_frac * 100))
    return df.withColumn(out, F.when(split_key(seed, key_col) % 100 < pct, F.lit("test")).otherwise(F.lit("train")))


def kfold_assign(df: DataFrame, label: str, key_col: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Stratified k-fold: fold = position within the label (seeded hash order) mod k."""
    d = df.withColumn("_h", h32("fold", seed, F.col(key_col)))
    pos = indexed(d, ["_h", key_col], [label])
    return pos.withColumn(out, (F.col("_idx") % k).cast("int")).drop("_h", "_idx")


def seeded_order(df: DataFrame, key_col: str, seed: int = 42, out: str = "position") -> DataFrame:
    """Seeded full shuffle as a stable position (independent of partitioning)."""
    d = df.withColumn("_h", h32("shuffle", seed, F.col(key_col)))
    return indexed(d, ["_h", key_col], idx_col=out).drop("_h")
