"""Profiling and exploratory aggregates (one pass where possible, long outputs)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.clean import exact_quantiles


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, null_count) in one scan; NaN counts as missing."""
    cols = cols or df.columns
    dtypes = dict(df.dtypes)

    def missing(c):
        m = F.col(c).isNull()
        if dtypes[c] in ("double", "float"):
            m = m | F.isnan(F.col(c))
        return F.sum(m.cast("long")).alias(c)

    wide = df.agg(*[missing(c) for c in cols])
    return wide.unpivot([], cols, "column", "null_count")


def to_long(df: DataFrame, cols: list[str], keys: list[str] | tuple = ()) -> DataFrame:
    """Unpivot numeric columns to (keys..., column, value DOUBLE)."""
    casted = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    return casted.unpivot(list(keys), cols, "column", "value")


def describe_numeric(df: DataFrame, cols: list[str], decimals: int = 6) -> DataFrame:
    """count, mean, std (ddof=1), min, exact 25/50/75 % (interpolated), max per column."""
    long = to_long(df, cols).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    basic = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    # One group per listed column, so both statistics tables are small by construction.
    qs = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["column"], few_groups=True)
    j = basic.join(F.broadcast(qs), "column")
    r = lambda c, a: F.round(F.col(c), decimals).alias(a)
    return j.select("column", "count", r("mean", "mean"), r("std", "std"), r("min", "min"),
                    r("q_0", "p25"), r("q_1", "p50"), r("q_2", "p75"), r("max", "max"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, count), ordered by count desc then value."""
    return df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")) \
        .agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), F.col("value"))


def group_means(df: DataFrame, key: str, measures: list[str], sort_by: str | None = None,
                decimals: int = 6) -> DataFrame:
    """Per-group means (NULL keys dropped), sorted ascending by ``sort_by``."""
    g = df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.round(F.avg(m), decimals).alias(f"avg_{m}") for m in measures])
    return g.orderBy(F.col(f"avg_{sort_by or measures[0]}"), F.col(key))


def pivot_counts(df: DataFrame, row_key: str, col_key: str, values: list[str]) -> DataFrame:
    """Two-key count pivoted on an explicit value list, zero-filled."""
    return df.groupBy(row_key).pivot(col_key, values).count().na.fill(0, subset=values)


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in cols])


def value_range(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias(f"min_{col}"), F.max(col).alias(f"max_{col}"))


def corr_matrix(df: DataFrame, cols: list[str], decimals: int = 6) -> DataFrame:
    """Pairwise-complete Pearson correlations of all column pairs, long (a, b, corr), one scan."""
    pairs = list(product(cols, cols))
    wide = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    long = wide.unpivot([], [f"{a}__{b}" for a, b in pairs], "pair", "corr")
    return long.select(F.split("pair", "__").getItem(0).alias("a"), F.split("pair", "__").getItem(1).alias("b"),
                       F.round("corr", decimals).alias("corr"))


def histogram(spark: SparkSession, df: DataFrame, col: str, bins: int, decimals: int = 6) -> DataFrame:
    """Equal-width histogram, last bin closed, empty bins kept (bin, lo, hi, count).

    A constant column spans [v - 0.5, v + 0.5] as in numpy.
    """
    v = df.select(F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    stats = v.agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
    stats = stats.select(
        F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo0"),
        F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi0"))
    stats = stats.withColumn("w", (F.col("hi0") - F.col("lo0")) / F.lit(float(bins)))
    # 1-row global statistics: broadcast is always safe.
    b = v.crossJoin(F.broadcast(stats)).select(
        F.least(F.floor((F.col("x") - F.col("lo0")) / F.col("w")), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = b.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    # The bin frame has exactly ``bins`` rows (a parameter), so it is small by construction.
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(stats))
    out = frame.join(counts, "bin", "left")
    return out.select("bin",
                      F.round(F.col("lo0") + F.col("bin") * F.col("w"), decimals).alias("lo"),
                      F.round(F.col("lo0") + (F.col("bin") + 1) * F.col("w"), decimals).alias("hi"),
                      F.coalesce(F.col("count"), F.lit(0)).alias("count"))
