"""Positions in a sorted order, per group, without a single-task window.

``indexed`` gives each row its 0-based position inside its group in the order
of ``order_cols``:

1. Cut points of the first order column split the key range into ``n_buckets``
   ordered buckets: ``percentile_approx`` for numbers, and for other types the
   quantiles of a bounded, hash-chosen row sample (one row for each of a fixed
   number of hash slots). A row's bucket is found by a binary search of fixed
   depth over the one-row cut array, one projection a step (native, codegen
   friendly). Buckets are a function of the data only, so recomputation after a
   lost task or a different AQE plan gives identical positions.
2. ``row_number`` within (group, bucket): a hot group is spread over
   ``n_buckets`` tasks instead of one.
3. The count of the group's rows in earlier buckets comes from a small
   (group, bucket) aggregate.

Order columns should make the order total (end with a unique key). Rows
with equal first order value share a bucket; when that value is hot, order
by a spread-out column first (a hash) or pre-aggregate (as the quantile
operator does). NULLs come first, as in an ascending sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators.barrier import barrier

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


#: Most buckets of one call, whatever the number of shuffle partitions.
MAX_BUCKETS = 4096
#: Sampled rows per bucket for columns without an approximate percentile.
SLOTS_PER_BUCKET = 16


def default_buckets(df: DataFrame) -> int:
    return min(MAX_BUCKETS, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _cut_row(df: DataFrame, first: str, n_buckets: int) -> DataFrame:
    """One row: the sorted, distinct cut points (at most ``n_buckets - 1``) of a column."""
    if isinstance(df.schema[first].dataType, _NUMERIC):
        probs = [i / n_buckets for i in range(1, n_buckets)]
        cuts = F.percentile_approx(F.col(first).cast("double"), probs, 10000)
        return df.agg(F.array_sort(F.array_distinct(cuts)).alias("_cuts"))
    slots = SLOTS_PER_BUCKET * n_buckets
    h = F.xxhash64(*df.columns)
    sample = df.filter(F.col(first).isNotNull()).select(F.col(first).alias("_x"), h.alias("_h")) \
        .groupBy(F.pmod(F.col("_h"), F.lit(slots)).alias("_slot")).agg(F.min_by("_x", "_h").alias("_x"))
    picked = sample.agg(F.array_sort(F.collect_list("_x")).alias("_s"))  # at most `slots` values
    take = F.array(*[F.get("_s", F.floor(F.size("_s") * F.lit(i / n_buckets)).cast("int"))
                     for i in range(1, n_buckets)])
    return picked.select(F.array_sort(F.array_distinct(F.array_compact(take))).alias("_cuts"))


def with_buckets(df: DataFrame, first: str, n_buckets: int, out: str = "_b", cuts_from: DataFrame | None = None) -> DataFrame:
    """Number of cut points (of ``cuts_from``, by default ``df``) below the value (NULL: 0), as column ``out``."""
    n_buckets = min(n_buckets, MAX_BUCKETS)
    if n_buckets <= 1:
        return df.withColumn(out, F.lit(0))
    # One row holding at most n_buckets - 1 values: broadcasting it is always safe.
    j = df.crossJoin(F.broadcast(_cut_row(df if cuts_from is None else cuts_from, first, n_buckets)))
    x = F.col(first)
    if isinstance(df.schema[first].dataType, _NUMERIC):
        x = x.cast("double")
    j = j.withColumn(out, F.lit(0))
    step = 1 << (n_buckets - 1).bit_length() - 1
    while step:
        # the cut at position out + step (1-based; NULL beyond the end) lies below x: move on by step
        j = j.withColumn(out, F.col(out) + F.when(F.get("_cuts", F.col(out) + F.lit(step - 1)) < x, F.lit(step))
                         .otherwise(F.lit(0)))
        step >>= 1
    return j.drop("_cuts")


def indexed(df: DataFrame, order_cols: list, group_cols: list[str] | tuple = (),
            idx_col: str = "_idx", n_buckets: int | None = None) -> DataFrame:
    group_cols = list(group_cols)
    first = order_cols[0] if isinstance(order_cols[0], str) else None
    n_buckets = n_buckets or default_buckets(df)

    def bucketed(part: DataFrame) -> DataFrame:
        # the join below drops null groups: without a barrier Spark tests that on the group's whole expression, inlined at every mention
        part = barrier(part) if group_cols else part
        return with_buckets(part, first, n_buckets, cuts_from=df) if first else part.withColumn("_b", F.lit(0))

    d = bucketed(df)
    w = Window.partitionBy(*group_cols, "_b").orderBy(*_cols(order_cols))
    ranked = d.withColumn("_rn", F.row_number().over(w) - 1)
    stats = bucketed(df.select(*dict.fromkeys([*group_cols, first] if first else group_cols))) if group_cols else d
    stats = stats.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    wb = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.withColumn("_before", F.coalesce(F.sum("_cnt").over(wb), F.lit(0))).drop("_cnt")
    out = ranked.join(offsets, group_cols + ["_b"], "inner")
    return out.withColumn(idx_col, (F.col("_before") + F.col("_rn")).cast("long")).drop("_b", "_rn", "_before")


def group_sizes(df: DataFrame, group_cols: list[str], name: str = "_n") -> DataFrame:
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias(name))
