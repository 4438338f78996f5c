"""Queries: scans, cleaning, profiling and exploratory aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import clean, profile
from furrow.plans.registry import register
from furrow.plans.sqlfrag import with_views
from furrow.sources import fixtures as fx
from furrow.sources.profiles import FERTILIZERS, profiles_df

YIELD_NUM = ["Temperature", "Humidity", "Soil_Moisture", "Area", "Production", "yield_per_hectare"]


def trimmed_yield(spark, sf):
    yc = clean.yield_clean(fx.yield_raw(spark, sf))
    return clean.trim_upper_quantile(yc, "yield_per_hectare", 0.99, key_col="rec_id")


@register("topn_groups", with_views("yield_trim") + """
SELECT Crop, round(avg(yield_per_hectare), 2) AS avg_value FROM yield_trim
WHERE Crop IS NOT NULL GROUP BY Crop ORDER BY avg(yield_per_hectare) DESC, Crop LIMIT 5""",
          ops="E6 B2 B3 B4 B5 E11 H9")
def topn_groups(spark, sf):
    """Top 5 crops by mean yield per hectare after cleaning and p99 trimming."""
    return clean.top_groups_by_mean(trimmed_yield(spark, sf), "Crop", "yield_per_hectare", 5)


@register("yield_clean", with_views("yield_clean") + """
SELECT count(*) AS n_rows, round(sum(yield_per_hectare), 4) AS sum_yield,
       round(min(yield_per_hectare), 6) AS min_yield, round(max(yield_per_hectare), 6) AS max_yield
FROM yield_clean""", ops="B2 B3 B4")
def yield_clean_q(spark, sf):
    yc = clean.yield_clean(fx.yield_raw(spark, sf))
    return yc.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("yield_per_hectare"), 4).alias("sum_yield"),
                  F.round(F.min("yield_per_hectare"), 6).alias("min_yield"),
                  F.round(F.max("yield_per_hectare"), 6).alias("max_yield"))


@register("yield_trim_p99", with_views("yield_clean") + """
SELECT round(quantile_cont(yield_per_hectare, 0.99), 6) AS p99,
       count(*) FILTER (WHERE yield_per_hectare <= quantile_cont_p) AS n_kept, count(*) AS n_before
FROM yield_clean, (SELECT quantile_cont(yield_per_hectare, 0.99) AS quantile_cont_p FROM yield_clean) q""",
          ops="B5 E11")
def yield_trim_p99(spark, sf):
    yc = clean.yield_clean(fx.yield_raw(spark, sf))
    thr = clean.exact_quantiles(yc, "yield_per_hectare", [0.99], key_col="rec_id").select(F.col("q_0").alias("t"))
    counted = yc.crossJoin(F.broadcast(thr)).groupBy("t").agg(
        F.sum((F.col("yield_per_hectare") <= F.col("t")).cast("long")).alias("n_kept"),
        F.count(F.lit(1)).alias("n_before"))
    return counted.select(F.round("t", 6).alias("p99"), "n_kept", "n_before")


@register("project_features", with_views("obs") + """
SELECT obs_id, N, P, K, Temperature, Humidity, pH, Rainfall FROM obs""", ops="B1")
def project_features(spark, sf):
    return fx.obs(spark, sf).select("obs_id", *fx.CROP_FEATURES)


@register("generate_obs", with_views("obs") + "SELECT * FROM obs", ops="C1 C3 C4 D6 A14")
def generate_obs(spark, sf):
    """Seeded, partition-stable observations: one per order, profile by hash."""
    return fx.obs(spark, sf)


@register("table_shape", with_views("yield_raw") + """
SELECT count(*) AS n_rows, 10 AS n_cols FROM yield_raw""", ops="A5")
def table_shape(spark, sf):
    return profile.table_shape(fx.yield_raw(spark, sf))


@register("preview_head", with_views("obs") + "SELECT * FROM obs ORDER BY obs_id LIMIT 5", ops="A4")
def preview_head(spark, sf):
    """First five observations in key order (a top-k: the limit is the feature)."""
    return fx.obs(spark, sf).orderBy("obs_id").limit(5)


@register("null_counts", with_views("yield_raw") + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL{' OR isnan(' + c + ')' if c in ('Temperature','Humidity','Soil_Moisture','Area','Production') else ''}) AS null_count FROM yield_raw"
    for c in ["rec_id", "State_Name", "Season", "Crop", "Crop_Year", "Temperature", "Humidity", "Soil_Moisture", "Area", "Production"]),
    ops="E1")
def null_counts(spark, sf):
    return profile.null_counts(fx.yield_raw(spark, sf))


def _describe_sql():
    parts = []
    for c in YIELD_NUM:
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
            f"round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
            f"round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM yield_clean")
    return with_views("yield_clean") + " UNION ALL ".join(parts)


@register("describe_numeric", _describe_sql(), ops="E2")
def describe_numeric(spark, sf):
    yc = clean.yield_clean(fx.yield_raw(spark, sf))
    return profile.describe_numeric(yc, YIELD_NUM)


@register("value_counts", with_views("obs") + """
SELECT Fertilizer AS value, count(*) AS count FROM obs WHERE Fertilizer IS NOT NULL GROUP BY Fertilizer""",
          ops="E3")
def value_counts(spark, sf):
    return profile.value_counts(fx.obs(spark, sf), "Fertilizer")


@register("group_mean", with_views("yield_trim") + """
SELECT Season, round(avg(yield_per_hectare), 6) AS avg_yield_per_hectare FROM yield_trim
WHERE Season IS NOT NULL GROUP BY Season""", ops="E4 H9")
def group_mean(spark, sf):
    return profile.group_means(trimmed_yield(spark, sf), "Season", ["yield_per_hectare"])


@register("group_mean_multi", with_views("obs") + """
SELECT Crop, round(avg(N), 6) AS avg_N, round(avg(P), 6) AS avg_P, round(avg(K), 6) AS avg_K FROM obs
GROUP BY Crop""", ops="E5")
def group_mean_multi(spark, sf):
    return profile.group_means(fx.obs(spark, sf), "Crop", ["N", "P", "K"], sort_by="N")


@register("pivot_counts", with_views("obs") + "SELECT Crop, " + ", ".join(
    f"count(*) FILTER (WHERE Fertilizer = '{f}') AS \"{f}\"" for f in FERTILIZERS) + " FROM obs GROUP BY Crop",
    ops="E7")
def pivot_counts(spark, sf):
    return profile.pivot_counts(fx.obs(spark, sf), "Crop", "Fertilizer", FERTILIZERS)


@register("distinct_counts", with_views("yield_clean") + """
SELECT count(DISTINCT State_Name) AS n_State_Name, count(DISTINCT Crop) AS n_Crop, count(DISTINCT Season) AS n_Season
FROM yield_clean""", ops="E8")
def distinct_counts(spark, sf):
    return profile.distinct_counts(clean.yield_clean(fx.yield_raw(spark, sf)), ["State_Name", "Crop", "Season"])


@register("distinct_values", with_views("yield_clean") + "SELECT DISTINCT Season FROM yield_clean", ops="E9 I1")
def distinct_values(spark, sf):
    return clean.yield_clean(fx.yield_raw(spark, sf)).select("Season").distinct()


@register("value_range", with_views("yield_clean") + """
SELECT min(Crop_Year) AS min_Crop_Year, max(Crop_Year) AS max_Crop_Year FROM yield_clean""", ops="E10")
def value_range(spark, sf):
    return profile.value_range(clean.yield_clean(fx.yield_raw(spark, sf)), "Crop_Year")


@register("corr_matrix", with_views("obs") + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM obs"
    for a in fx.CROP_FEATURES for b in fx.CROP_FEATURES), ops="E12")
def corr_matrix(spark, sf):
    return profile.corr_matrix(fx.obs(spark, sf), fx.CROP_FEATURES)


def _hist_sql(bins):
    return with_views("yield_trim") + f"""
, s0 AS (SELECT min(yield_per_hectare) AS mn, max(yield_per_hectare) AS mx FROM yield_trim WHERE yield_per_hectare IS NOT NULL),
s AS (SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo0, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi0 FROM s0),
s2 AS (SELECT lo0, hi0, (hi0 - lo0) / {float(bins)} AS w FROM s),
b AS (SELECT CAST(least(floor((yield_per_hectare - lo0) / w), {bins - 1}) AS INTEGER) AS bin FROM yield_trim, s2
      WHERE yield_per_hectare IS NOT NULL),
c AS (SELECT bin, count(*) AS count FROM b GROUP BY bin)
SELECT CAST(r.bin AS INTEGER) AS bin, round(lo0 + r.bin * w, 6) AS lo, round(lo0 + (r.bin + 1) * w, 6) AS hi,
       coalesce(c.count, 0) AS count
FROM (SELECT range AS bin FROM range({bins})) r CROSS JOIN s2 LEFT JOIN c ON c.bin = r.bin"""


@register("histogram_bins", _hist_sql(50), ops="E13")
def histogram_bins(spark, sf):
    return profile.histogram(spark, trimmed_yield(spark, sf), "yield_per_hectare", 50)


@register("profile_dim", with_views("profiles", "obs") + """
SELECT p.crop, c.n_obs, p.N_lo_i / 10.0 AS N_lo, (p.N_lo_i + p.N_span) / 10.0 AS N_hi,
       array_to_string(p.soils, '|') AS soils, p.f_balanced AS fert_balanced
FROM profiles p JOIN (SELECT Crop, count(*) AS n_obs FROM obs GROUP BY Crop) c ON p.crop = c.Crop""", ops="A14")
def profile_dim(spark, sf):
    """The profile dimension attached to the observations that use it (per-crop counts)."""
    ob = fx.obs(spark, sf).groupBy(F.col("Crop").alias("obs_crop")).agg(F.count(F.lit(1)).alias("n_obs"))
    prof = F.broadcast(profiles_df(spark))
    return prof.join(ob, prof.crop == ob.obs_crop).select(
        "crop", "n_obs", F.col("N.lo").alias("N_lo"), F.col("N.hi").alias("N_hi"),
        F.array_join("soils", "|").alias("soils"), F.element_at("fmap", "balanced").alias("fert_balanced"))
