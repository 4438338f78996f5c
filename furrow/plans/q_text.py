"""Queries: rule columns, text routing, extraction, splitting and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import rules, text
from furrow.operators import vocab
from furrow.plans.registry import register
from furrow.plans.sqlfrag import q, sql_list, with_views
from furrow.sources import fixtures as fx
from furrow.sources.profiles import PROFILES, SOILS

MSG_KEY = ["src", "msg_id", "turn"]

# ---- SQL helpers (DuckDB dialect) -------------------------------------------------


def _sql_any(expr, words):
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def sql_intent(col="text"):
    low = f"lower({col})"
    return (f"CASE WHEN {_sql_any(low, text.CROP_KEYWORDS)} THEN 'crop' "
            f"WHEN {_sql_any(low, text.FERT_KEYWORDS)} AND contains({low}, 'predict') THEN 'fertilizer' "
            f"WHEN {_sql_any(low, text.YIELD_KEYWORDS)} AND contains({low}, 'predict') THEN 'yield' "
            f"ELSE 'general' END")


def sql_param(col, patterns, default):
    whens = " ".join(f"WHEN regexp_matches({col}, {q('(?i)' + p)}) THEN "
                     f"TRY_CAST(regexp_extract({col}, {q('(?i)' + p)}, 1) AS DOUBLE)" for p in patterns)
    return f"CASE {whens} ELSE {float(default)} END"


def sql_params(col="text"):
    return ", ".join(f"{sql_param(col, pats, d)} AS {name}" for name, pats, d in text.PARAM_PATTERNS)


def sql_strip(e):
    return f"regexp_replace(regexp_replace({e}, '^\\s+', ''), '\\s+$', '')"


def sql_first_contained(col, vocab_sql, strip_items=False):
    item = f"lower({sql_strip('v')})" if strip_items else "lower(v)"
    return (f"coalesce(list_filter({vocab_sql}, lambda v: contains(lower({col}), {item}))[1], ({vocab_sql})[1])")


# ---- rule columns ----------------------------------------------------------------


@register("limiting_nutrient", with_views("obs") + """
SELECT obs_id, CASE WHEN N = least(N, P, K) THEN 'N' WHEN P = least(N, P, K) THEN 'P' ELSE 'K' END AS limiting,
       least(N, P, K) < 10 AS is_low, Fertilizer FROM obs""", ops="C1")
def limiting_nutrient(spark, sf):
    o = fx.obs(spark, sf)
    return o.select("obs_id", rules.limiting_key(F.col("N"), F.col("P"), F.col("K")).alias("limiting"),
                    (F.least("N", "P", "K") < rules.LOW_NUTRIENT).alias("is_low"), "Fertilizer")


@register("round_clip_class", with_views("obs") + """
SELECT obs_id, CAST(least(greatest(CAST(round_even((N - 50) / 10, 0) AS INTEGER), 0), 21) AS INTEGER) AS cls FROM obs""",
          ops="C5")
def round_clip_class(spark, sf):
    o = fx.obs(spark, sf)
    return o.select("obs_id", rules.round_clip_class((F.col("N") - 50) / 10, 22).alias("cls"))


@register("yield_rating", with_views("yield_scored") + """
SELECT rec_id, round(greatest(0.0, yhat), 6) AS predicted, round(greatest(0.0, yhat) * Area, 6) AS total,
  CASE WHEN greatest(0.0, yhat) >= 5.0 THEN 'Excellent' WHEN greatest(0.0, yhat) >= 2.5 THEN 'Good'
       WHEN greatest(0.0, yhat) >= 1.0 THEN 'Average' ELSE 'Low' END AS rating FROM yield_scored""",
          ops="C6 C7 C8")
def yield_rating(spark, sf):
    s = fx.yield_scored(spark, sf)
    pred = rules.non_negative(F.col("yhat"))
    return s.select("rec_id", F.round(pred, 6).alias("predicted"), F.round(pred * F.col("Area"), 6).alias("total"),
                    rules.yield_rating(pred).alias("rating"))


@register("field_advisories", with_views("yield_raw") + f"""
SELECT rec_id, array_to_string(list_filter([
   CASE WHEN Temperature > 38 THEN {q(rules.ADVISORY_HOT)} WHEN Temperature < 15 THEN {q(rules.ADVISORY_COLD)} END,
   CASE WHEN Humidity < 30 THEN {q(rules.ADVISORY_DRY_AIR)} END,
   CASE WHEN Soil_Moisture < 20 THEN {q(rules.ADVISORY_DRY_SOIL)} END], lambda x: x IS NOT NULL), ' | ') AS advisories
FROM yield_raw""", ops="C9")
def field_advisories(spark, sf):
    y = fx.yield_raw(spark, sf)
    adv = rules.field_advisories(F.col("Temperature"), F.col("Humidity"), F.col("Soil_Moisture"))
    return y.select("rec_id", F.array_join(adv, " | ").alias("advisories"))


@register("deficiency_list", with_views("obs") + """
SELECT obs_id, CASE WHEN N < 5 OR P < 5 OR K < 5 THEN array_to_string(list_filter([
    CASE WHEN N < 5 THEN 'Nitrogen (N)' END, CASE WHEN P < 5 THEN 'Phosphorus (P)' END,
    CASE WHEN K < 5 THEN 'Potassium (K)' END], lambda x: x IS NOT NULL), ', ') ELSE 'adequate' END AS deficiency FROM obs""",
          ops="C10")
def deficiency_list(spark, sf):
    o = fx.obs(spark, sf)
    return o.select("obs_id", rules.deficiency_list(F.col("N"), F.col("P"), F.col("K")).alias("deficiency"))


# ---- text --------------------------------------------------------------------------


@register("string_case_trim", with_views("yield_raw") + f"""
SELECT rec_id, Season AS raw, {sql_strip('Season')} AS stripped, lower(Season) AS lower, upper(Crop) AS upper,
       upper(substr(Crop, 1, 1)) || lower(substr(Crop, 2)) AS capitalized, trim(Season) = {sql_strip('Season')} AS same_as_trim
FROM yield_raw""", ops="C11 A3")
def string_case_trim(spark, sf):
    y = fx.yield_raw(spark, sf)
    return y.select("rec_id", F.col("Season").alias("raw"), text.strip_ws(F.col("Season")).alias("stripped"),
                    F.lower("Season").alias("lower"), F.upper("Crop").alias("upper"),
                    text.capitalize(F.col("Crop")).alias("capitalized"),
                    (F.trim("Season") == text.strip_ws(F.col("Season"))).alias("same_as_trim"))


@register("text_preview", with_views("corpus") + """
SELECT id, substr(text, 1, 100) || '...' AS preview, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...'
       ELSE text END AS short_preview FROM corpus""", ops="C12")
def text_preview(spark, sf):
    c = fx.corpus(spark, sf)
    return c.select("id", F.concat(F.substring("text", 1, 100), F.lit("...")).alias("preview"),
                    text.preview(F.col("text"), 50).alias("short_preview"))


@register("detect_intent", with_views("messages") + f"SELECT src, msg_id, turn, {sql_intent()} AS intent FROM messages",
          ops="C13 L1")
def detect_intent(spark, sf):
    m = fx.messages(spark, sf)
    return m.select(*MSG_KEY, text.detect_intent(F.col("text")).alias("intent"))


@register("extract_params", with_views("messages") + f"""
SELECT *, (N IS NULL OR P IS NULL OR K IS NULL OR temperature IS NULL OR humidity IS NULL OR ph IS NULL
           OR rainfall IS NULL) AS error FROM (SELECT src, msg_id, turn, {sql_params()} FROM messages) z""",
          ops="C14 C19")
def extract_params(spark, sf):
    m = fx.messages(spark, sf)
    p = m.select(*MSG_KEY, text.extract_params(F.col("text")).alias("p"))
    return p.select(*MSG_KEY, "p.*", text.params_error(F.col("p")).alias("error"))


FERT_CROPS = sorted(p[0] for p in PROFILES)
SORTED_SOILS = sorted(SOILS)


def _entity_sql():
    yv = ("yv AS (SELECT list_sort(list(DISTINCT Crop)) AS crops, list_sort(list(DISTINCT State_Name)) AS states, "
          "list_sort(list(DISTINCT Season)) AS seasons FROM yield_clean)")
    return with_views("messages", "yield_clean") + ", " + yv + f"""
SELECT src, msg_id, turn, {sql_first_contained('text', sql_list(SORTED_SOILS))} AS soil,
  {sql_first_contained('text', sql_list(FERT_CROPS))} AS crop,
  {sql_first_contained('text', 'yv.crops')} AS yield_crop,
  {sql_first_contained('text', 'yv.states')} AS yield_state,
  {sql_strip(sql_first_contained('text', 'yv.seasons', strip_items=True))} AS yield_season
FROM messages CROSS JOIN yv"""


@register("detect_entity", _entity_sql(), ops="C15 D4 D5 H12")
def detect_entity(spark, sf):
    """First vocabulary item contained in each message (fixed and data-derived vocabularies)."""
    from furrow.operators.clean import yield_clean
    m = fx.messages(spark, sf)
    yc = yield_clean(fx.yield_raw(spark, sf))
    voc = vocab.distinct_values(yc, {"yield_crop": "Crop", "yield_state": "State_Name", "yield_season": "Season"})
    j = vocab.attach_first_contained(m, "text", voc, ["yield_crop", "yield_state", "yield_season"], strip={"yield_season"})
    return j.select(*MSG_KEY,
                    text.first_contained(F.col("text"), SORTED_SOILS).alias("soil"),
                    text.first_contained(F.col("text"), FERT_CROPS).alias("crop"),
                    "yield_crop", "yield_state", text.strip_ws(F.col("yield_season")).alias("yield_season"))


def _split_sql():
    parts = f"string_split_regex(regexp_replace({sql_strip('content')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return with_views("chat") + f"""
SELECT conv_id, turn, CASE WHEN len(s) <= 3 THEN content ELSE array_to_string(s[1:2], ' ') END AS summary,
       CASE WHEN len(s) <= 3 THEN NULL ELSE array_to_string(s[3:], ' ') END AS detail, len(s) AS n_sentences
FROM (SELECT conv_id, turn, content, {parts} AS s FROM chat) z"""


@register("split_response", _split_sql(), ops="C16")
def split_response(spark, sf):
    c = fx.chat(spark, sf)
    r = c.select("conv_id", "turn", text.split_response(F.col("content")).alias("r"),
                 F.size(text.split_sentences(F.col("content"))).alias("n_sentences"))
    return r.select("conv_id", "turn", "r.summary", "r.detail", "n_sentences")


def _dec(e, d):
    return f"CAST(CAST({e} AS DECIMAL(18,{d})) AS VARCHAR)"


@register("render_prediction", with_views("yield_scored") + f"""
SELECT rec_id, upper(substr(Crop, 1, 1)) || lower(substr(Crop, 2)) || ', ' || State_Name || ' / ' || {sql_strip('Season')} || ' '
  || CAST(Crop_Year AS VARCHAR) || ': ' || {_dec('greatest(0.0, yhat)', 2)} || ' t per ha x ' || {_dec('Area', 2)}
  || ' ha = ' || {_dec('greatest(0.0, yhat) * Area', 1)} || ' t' AS summary FROM yield_scored""", ops="C17 C20 C2")
def render_prediction(spark, sf):
    s = fx.yield_scored(spark, sf)
    pred = rules.non_negative(F.col("yhat"))
    dec = lambda c, d: c.cast(f"decimal(18,{d})").cast("string")
    summary = F.concat(text.capitalize(F.col("Crop")), F.lit(", "), F.col("State_Name"), F.lit(" / "),
                       text.strip_ws(F.col("Season")), F.lit(" "), F.col("Crop_Year").cast("string"), F.lit(": "), dec(pred, 2),
                       F.lit(" t per ha x "), dec(F.col("Area"), 2), F.lit(" ha = "), dec(pred * F.col("Area"), 1), F.lit(" t"))
    return s.select("rec_id", summary.alias("summary"))
