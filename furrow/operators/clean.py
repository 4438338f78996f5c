"""Cleaning: null/positivity filters, derived ratio, exact quantile trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drop_null_rows(df: DataFrame, subset: list[str]) -> DataFrame:
    """Drop rows holding NULL (or NaN) in any of ``subset``."""
    return df.na.drop(subset=subset)


def yield_clean(df: DataFrame, production: str = "Production", area: str = "Area",
                out: str = "yield_per_hectare") -> DataFrame:
    """Drop missing/non-positive production or area, derive production / area."""
    d = drop_null_rows(df, [production, area])
    d = d.filter((F.col(area) > 0) & (F.col(production) > 0))
    return d.withColumn(out, F.try_divide(F.col(production), F.col(area)))


#: Relative rank error asked of the approximate digest that brackets a quantile.
QUANTILE_ACCURACY = 20_000


def exact_quantiles(df: DataFrame, value_col: str, qs: list[float], group_cols: list[str] | tuple = (),
                    key_col: str | None = None, few_groups: bool = False) -> DataFrame:
    """Exact, linearly interpolated quantiles per group (pandas / quantile_cont rule).

    Two passes over the value column alone, without a sort of all values:

    1. ``percentile_approx`` (partial + final aggregate) gives a bracket of a few
       times its rank error around each wanted position.
    2. Rows below the bracket are only counted (with their largest value), rows above
       it leave their smallest value, and rows inside are reduced to (value, count).
       A running count over the values inside finds the two order statistics.

    A position outside its bracket would break the documented error bound of the
    digest; it raises instead of returning a wrong value. Output: group columns +
    ``q_<i>`` per requested quantile. ``few_groups`` says that the number of groups is
    fixed by a parameter, so that the brackets may be broadcast. (``key_col`` is
    accepted for API symmetry; ties need no key here.)
    """
    group_cols = list(group_cols)
    v = df.select(*group_cols, F.col(value_col).cast("double").alias("_v")) \
        .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    slack = 3.0 / QUANTILE_ACCURACY
    probs = [p for q in qs for p in (max(0.0, q - slack), min(1.0, q + slack))]
    digest = v.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", probs, QUANTILE_ACCURACY).alias("_b"))
    wanted = []
    for i, q in enumerate(qs):
        p = (F.col("_n") - 1).cast("double") * F.lit(float(q))
        wanted.append(F.struct(F.lit(i).alias("qi"), p.alias("p"), F.floor(p).alias("lo"), F.ceil(p).alias("hi"),
                               F.get("_b", F.lit(2 * i)).alias("bl"), F.get("_b", F.lit(2 * i + 1)).alias("bh")))
    brackets = digest.filter("_n > 0").select(*group_cols, F.array(*wanted).alias("_w"))
    if not group_cols:  # one row
        rows = v.crossJoin(F.broadcast(brackets))
    else:
        brackets = brackets.withColumnsRenamed({c: f"_g_{c}" for c in group_cols})
        on = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group_cols]
        rows = v.join(F.broadcast(brackets) if few_groups else brackets, on)
    rows = rows.select(*group_cols, "_v", F.inline("_w"))
    side = F.when(F.col("_v") < F.col("bl"), F.lit(-1)).when(F.col("_v") > F.col("bh"), F.lit(1)).otherwise(F.lit(0))
    keys = [*group_cols, "qi", "p", "lo", "hi"]
    cells = rows.withColumn("_side", side) \
        .groupBy(*keys, "_side", F.when(F.col("_side") == 0, F.col("_v")).alias("_in")) \
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_side", "_in").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_end", F.sum("_c").over(w)).withColumn("_start", F.col("_end") - F.col("_c"))

    def at(pos):
        """Value at a row position: any row of a value inside, the last one below, the first one above."""
        known = (F.when(F.col("_side") == 0, (F.col("_start") <= pos) & (pos < F.col("_end")))
                 .when(F.col("_side") < 0, pos == F.col("_end") - 1).otherwise(pos == F.col("_start")))
        return F.max(F.when(known, F.when(F.col("_side") < 0, F.col("_last")).otherwise(F.col("_first"))))

    per_q = cells.groupBy(*keys).agg(at(F.col("lo")).alias("vlo"), at(F.col("hi")).alias("vhi"))
    val = F.col("vlo") + (F.col("vhi") - F.col("vlo")) * (F.col("p") - F.col("lo").cast("double"))
    val = F.coalesce(val, F.raise_error(F.lit("quantile position outside its bracket")).cast("double"))
    per_q = per_q.select(*group_cols, "qi", val.alias("_q"))
    return per_q.groupBy(*group_cols).agg(
        *[F.max(F.when(F.col("qi") == i, F.col("_q"))).alias(f"q_{i}") for i in range(len(qs))])


def trim_upper_quantile(df: DataFrame, col: str, q: float = 0.99, key_col: str | None = None) -> DataFrame:
    """Keep rows with ``col <= quantile(col, q)`` (exact, interpolated); the input is streamed, never gathered."""
    thr = exact_quantiles(df, col, [q], key_col=key_col).select(F.col("q_0").alias("_thr"))
    # A global quantile is exactly one row: broadcasting it is always safe.
    return df.crossJoin(F.broadcast(thr)).filter(F.col(col) <= F.col("_thr")).drop("_thr")


def top_groups_by_mean(df: DataFrame, group_col: str, value_col: str, n: int,
                       out: str = "avg_value", decimals: int = 2) -> DataFrame:
    """Top-n groups by mean value (descending; ties by group key). A top-k report."""
    g = df.filter(F.col(group_col).isNotNull()).groupBy(group_col).agg(F.avg(value_col).alias(out))
    return g.orderBy(F.col(out).desc(), F.col(group_col)).limit(n) \
        .select(group_col, F.round(out, decimals).alias(out))
