"""Queries: encoding, scaling, splits, folds, lookups, shuffles."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import text
from furrow.operators import clean, encode
from furrow.plans.q_text import sql_strip
from furrow.plans.registry import register
from furrow.plans.sqlfrag import Raw, h32, with_views
from furrow.sources import fixtures as fx


def _yc(spark, sf):
    return clean.yield_clean(fx.yield_raw(spark, sf))


@register("label_encode", with_views("yield_clean") + """
SELECT rec_id, CAST(Crop_Year AS VARCHAR) AS Crop_Year_str,
  CAST(dense_rank() OVER (ORDER BY Crop) - 1 AS INTEGER) AS Crop_code,
  CAST(dense_rank() OVER (ORDER BY Season) - 1 AS INTEGER) AS Season_code,
  CAST(dense_rank() OVER (ORDER BY State_Name) - 1 AS INTEGER) AS State_Name_code FROM yield_clean""",
          ops="G1 D1 B6")
def label_encode(spark, sf):
    yc = _yc(spark, sf)
    out = yc.select("rec_id", F.col("Crop_Year").cast("string").alias("Crop_Year_str"), "Crop", "Season", "State_Name")
    for c in ["Crop", "Season", "State_Name"]:
        out = encode.encode(out, c, encode.fit_label_codes(yc, c))
    return out.drop("Crop", "Season", "State_Name")


@register("label_decode", with_views("yield_clean") + """
SELECT DISTINCT CAST(dense_rank() OVER (ORDER BY State_Name) - 1 AS INTEGER) AS code, State_Name AS decoded FROM yield_clean""",
          ops="D2")
def label_decode(spark, sf):
    yc = _yc(spark, sf)
    vocab = encode.fit_label_codes(yc, "State_Name")
    codes = encode.encode(yc.select("State_Name"), "State_Name", vocab, out="code").select("code").distinct()
    return encode.decode(codes, "code", vocab, "decoded")


@register("unknown_labels", with_views("messages", "yield_clean") + """
SELECT value, count(*) AS n_rows FROM (SELECT regexp_extract(text, 'yield of (\\w+)', 1) AS value FROM messages
  WHERE regexp_matches(text, 'yield of (\\w+)')) m
WHERE value NOT IN (SELECT DISTINCT Crop FROM yield_clean) GROUP BY value""", ops="D3")
def unknown_labels(spark, sf):
    """Crop names asked about in messages that the yield vocabulary does not know (exact match)."""
    m = fx.messages(spark, sf).filter(F.col("text").rlike(r"yield of (\w+)")) \
        .select(F.regexp_extract("text", r"yield of (\w+)", 1).alias("asked"))
    return encode.unknown_values(m, "asked", encode.fit_label_codes(_yc(spark, sf), "Crop"))


@register("season_match", with_views("yield_clean") + f"""
SELECT {sql_strip('Season')} AS season, min(Season) AS matched FROM yield_clean GROUP BY {sql_strip('Season')}""",
          ops="D5")
def season_match(spark, sf):
    """Whitespace-normalised key -> first raw vocabulary value (code-point order)."""
    vocab = encode.fit_label_codes(_yc(spark, sf), "Season")
    keyed = vocab.select(text.strip_ws(F.col("value")).alias("season"), "value", "code")
    return keyed.groupBy("season").agg(F.min_by("value", "code").alias("matched"))


@register("standardize", with_views("obs") + ", st AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in fx.CROP_FEATURES) + " FROM obs)\nSELECT obs_id, " + ", ".join(
    f"round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END, 6) AS {c}" for c in fx.CROP_FEATURES)
    + " FROM obs CROSS JOIN st", ops="G2")
def standardize(spark, sf):
    return encode.standardize(fx.obs(spark, sf), fx.CROP_FEATURES, ["obs_id"])


_SPLIT_H = h32("split", 42, Raw("obs_id"))


@register("stratified_split", with_views("obs") + f"""
SELECT obs_id, Crop, CASE WHEN rn < round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT obs_id, Crop, row_number() OVER (PARTITION BY Crop ORDER BY {_SPLIT_H}, obs_id) - 1 AS rn,
         count(*) OVER (PARTITION BY Crop) AS n FROM obs) z""", ops="G4")
def stratified_split(spark, sf):
    o = fx.obs(spark, sf).select("obs_id", "Crop")
    return encode.stratified_split(o, "Crop", "obs_id")


@register("hash_split", with_views("yield_clean") + f"""
SELECT rec_id, CASE WHEN {h32('split', 42, Raw('rec_id'))} % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM yield_clean""",
          ops="G5")
def hash_split(spark, sf):
    return encode.hash_split(_yc(spark, sf).select("rec_id"), "rec_id")


@register("kfold_assign", with_views("obs") + f"""
SELECT obs_id, Crop, CAST((row_number() OVER (PARTITION BY Crop ORDER BY {h32('fold', 42, Raw('obs_id'))}, obs_id) - 1) % 5 AS INTEGER) AS fold
FROM obs""", ops="G6")
def kfold_assign(spark, sf):
    return encode.kfold_assign(fx.obs(spark, sf).select("obs_id", "Crop"), "Crop", "obs_id", 5)


@register("seeded_shuffle", with_views("obs") + f"""
SELECT obs_id, row_number() OVER (ORDER BY {h32('shuffle', 42, Raw('obs_id'))}, obs_id) - 1 AS position FROM obs""",
          ops="H11")
def seeded_shuffle(spark, sf):
    return encode.seeded_order(fx.obs(spark, sf).select("obs_id"), "obs_id")


@register("vocab_tables", with_views("yield_clean") + " UNION ALL ".join(
    f"SELECT '{c}' AS vocab, value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code "
    f"FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS value FROM yield_clean) d{i}"
    for i, c in enumerate(["Crop", "Season", "State_Name"])), ops="A9 H12")
def vocab_tables(spark, sf):
    yc = _yc(spark, sf)
    out = None
    for c in ["Crop", "Season", "State_Name"]:
        v = encode.fit_label_codes(yc, c).select(F.lit(c).alias("vocab"), "value", "code")
        out = v if out is None else out.unionByName(v)
    return out
