"""Fixture views over the driver tables (see FIXTURES.md section 2).

Every view is a lazy DataFrame derived from the scale-factor tables, so its
size grows with them. Pseudo-random values come from md5-keyed hashes
(``furrow.functions.hashing``); ``furrow.plans.sqlfrag`` holds the same
definitions as SQL for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.hashing import h32, pick, uniform, uniform_cols
from furrow.functions.rules import limiting_nutrient
from furrow.sources.profiles import PROFILES, RANGE_FIELDS, SOILS, profiles_df
from furrow.sources.tables import table

OBS_FIELDS = [  # output column, profile range, decimals
    ("Temperature", "temperature", 2), ("Humidity", "humidity", 2), ("Rainfall", "rainfall", 2),
    ("pH", "ph", 2), ("N", "N", 1), ("P", "P", 1), ("K", "K", 1),
]
OBS_NUMERIC = [c for c, _, _ in OBS_FIELDS]
CROP_FEATURES = ["N", "P", "K", "Temperature", "Humidity", "pH", "Rainfall"]
FERT_FEATURES = ["Temperature", "Humidity", "Rainfall", "pH", "N", "P", "K", "Soil", "Crop"]
YIELD_FEATURES = ["Crop", "Season", "State_Name", "Temperature", "Humidity", "Soil_Moisture",
                  "Area", "Crop_Year"]
N_PROFILES = len(PROFILES)
PART_TYPES = ["economy", "large", "medium", "promo", "small", "standard"]
#: Line items that one task of a join sorts, at most (about).
JOIN_ROWS = 500_000


def obs_with_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generated observation per order, keeping the profile's fertilizer map."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id"))
    keyed = orders.withColumn("pidx", (h32("crop", F.col("obs_id")) % N_PROFILES).cast("int"))
    # 22-row literal dimension: broadcasting it is always safe.
    prof = F.broadcast(profiles_df(spark))
    j = keyed.join(prof, "pidx")
    cols = [F.col("obs_id"), F.col("pidx")]
    for out, rng, d in OBS_FIELDS:
        cols.append(uniform_cols(F.col(f"{rng}.lo"), F.col(f"{rng}.hi"), d, rng, F.col("obs_id")).alias(out))
    cols += [pick(F.col("soils"), "soil", F.col("obs_id")).alias("Soil"), F.col("crop").alias("Crop"),
             F.col("fmap")]
    g = j.select(*cols)
    return g.withColumn("Fertilizer", limiting_nutrient(F.col("N"), F.col("P"), F.col("K"), F.col("fmap")))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs_with_profile(spark, sf_dir).drop("pidx", "fmap")


def yield_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yield records with injected faults (nulls, zeros, 1000x outliers, padded seasons)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    # A fixed number of shuffle partitions would let the sorts of a task grow with the table.
    parts = -(-li.count() // JOIN_ROWS)
    many = parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df, key: df.repartition(parts, key) if many else df
    # orders -> customer -> nation first: the smaller side is enriched before
    # the lineitem join, so lineitem is shuffled once on l_orderkey.
    oc = (dealt(o, "o_custkey").join(dealt(c, "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
          .join(n, F.col("c_nationkey") == n.n_nationkey)
          .select("o_orderkey", "o_orderpriority", "n_name"))
    j = dealt(li, "l_orderkey").join(dealt(oc, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = dealt(j, "l_partkey").join(dealt(p, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    k = F.col("l_orderkey")
    rec = k * 8 + F.col("l_linenumber")
    pad = h32("season", F.col("o_orderkey")) % 3
    season = (F.when(pad == 0, F.concat(F.col("o_orderpriority"), F.lit("  ")))
              .when(pad == 1, F.concat(F.col("o_orderpriority"), F.lit(" \t")))
              .otherwise(F.col("o_orderpriority")))
    return j.select(
        rec.alias("rec_id"),
        F.col("n_name").alias("State_Name"),
        season.alias("Season"),
        F.col("p_type").alias("Crop"),
        F.year("l_shipdate").alias("Crop_Year"),
        F.when(k % 101 == 0, F.lit(None).cast("double"))
         .otherwise(uniform(10, 45, 1, "temp", rec)).alias("Temperature"),
        uniform(20, 95, 1, "hum", rec).alias("Humidity"),
        uniform(5, 60, 1, "moist", rec).alias("Soil_Moisture"),
        F.when(k % 97 == 0, F.lit(None).cast("double")).when(k % 89 == 0, F.lit(0.0))
         .otherwise(F.col("l_quantity")).alias("Area"),
        F.when(k % 83 == 0, F.lit(None).cast("double")).when(k % 211 == 0, F.col("l_extendedprice") * 1000)
         .otherwise(F.col("l_extendedprice")).alias("Production"),
    )


def _arr(values):
    return F.array(*[F.lit(v) for v in values])


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text messages: six templates over orders, plus the user turns of conversations.

    Key = (src, msg_id, turn). Numbers in the text are integers taken from
    keys; one slice carries a malformed number ("6.5.1").
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    a, b, c = k % 140, F.floor(k / 7) % 145, F.floor(k / 11) % 205
    t, hu, rn = k % 36 + 8, k % 82 + 14, k % 280 + 20
    ph = F.when(F.floor(k / 6) % 10 == 3, F.lit("6.5.1")).otherwise(s(k % 5 + 4))
    crop = F.element_at(_arr([p[0] for p in PROFILES]), (F.floor(k / 6) % N_PROFILES).cast("int") + 1)
    soil = F.element_at(_arr(SOILS), (F.floor(k / 5) % len(SOILS)).cast("int") + 1)
    typ = F.element_at(_arr(PART_TYPES), (F.floor(k / 3) % len(PART_TYPES)).cast("int") + 1)
    state = F.concat(F.lit("NATION_"), s(F.col("o_custkey") % 25))
    season = F.lower(F.col("o_orderpriority"))
    tpl = k % 6
    text = (
        F.when(tpl == 0, F.concat(F.lit("What crop should I grow? N="), s(a), F.lit(", P="), s(b),
                                  F.lit(", K="), s(c), F.lit(", temperature="), s(t),
                                  F.lit(", humidity="), s(hu), F.lit(", ph="), ph,
                                  F.lit(", rainfall="), s(rn)))
        .when(tpl == 1, F.concat(F.lit("Which crop suits nitrogen: "), s(a), F.lit(" and rain = "),
                                 s(rn), F.lit(" mm?")))
        .when(tpl == 2, F.concat(F.lit("Please predict fertilizer for "), crop, F.lit(" in "), soil,
                                 F.lit(" soil, N="), s(a), F.lit(" P="), s(b), F.lit(" K="), s(c),
                                 F.lit(" ph="), ph))
        .when(tpl == 3, F.concat(F.lit("Can you predict the yield of "), typ, F.lit(" in "), state,
                                 F.lit(" during "), season, F.lit(" season? temp: "), s(t)))
        .when(tpl == 4, F.concat(F.lit("Which fertilizer is best for "), crop, F.lit(" in "), soil,
                                 F.lit(" soil? It is "), s(t), F.lit("°C here.")))
        .otherwise(F.concat(F.lit("Tell me about irrigation. Humidity="), s(hu), F.lit(". Is "), s(t),
                            F.lit(" C too hot? Thanks!")))
    )
    om = o.select(F.lit("order").alias("src"), k.alias("msg_id"), F.lit(0).cast("long").alias("turn"),
                  text.alias("text"))
    conv = table(spark, sf_dir, "conversations")
    cm = conv.filter(F.col("role") == "user").select(
        F.lit("chat").alias("src"), F.col("conv_id").alias("msg_id"), F.col("turn").cast("long").alias("turn"),
        F.col("text"))
    return om.unionByName(cm)


def kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval store over ``embeddings``: id, text, category, topic (NULL on some ids), embedding."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("Passage "), F.col("vec_id").cast("string"), F.lit(" on topic "),
                 F.col("label").cast("string"), F.lit(".")).alias("text"),
        F.concat(F.lit("cat_"), F.col("label").cast("string")).alias("category"),
        F.when(F.col("vec_id") % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("topic_"), F.col("label").cast("string"))).alias("topic"),
        F.col("embedding"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("category"),
                    F.col("source").alias("topic"), F.col("text"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", F.col("text").alias("content"))


CLS_MODELS = [("rule_jitter5", 5), ("rule_jitter15", 15), ("rule_jitter40", 40)]


def preds_cls_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, Crop, y, one yhat column a model): the fertilizer rule applied to jittered N, P, K.

    The jittered values are columns of their own: the rule names each of them several times, and inside the
    generator of the long form Spark hashes once per mention.
    """
    ob = obs_with_profile(spark, sf_dir)

    def jitter(name, spread, col):
        return F.col(col) + (h32(name, col, F.col("obs_id")) % (2 * spread + 1) - spread).cast("double")

    jittered = ob.select("obs_id", "Crop", F.col("Fertilizer").alias("y"), "fmap",
                         *[jitter(name, spread, c).alias(f"{name}_{c}") for name, spread in CLS_MODELS for c in "NPK"])
    return jittered.select("obs_id", "Crop", "y", *[limiting_nutrient(*[F.col(f"{name}_{c}") for c in "NPK"], F.col("fmap")).alias(name)
                                                    for name, _ in CLS_MODELS])


def preds_long(wide: DataFrame) -> DataFrame:
    """One row a model, with columns model and yhat, of a table with ``preds_cls_wide``'s columns."""
    names = [name for name, _ in CLS_MODELS]
    models = F.array(*[F.struct(F.lit(name).alias("model"), F.col(name).alias("yhat")) for name in names])
    return wide.select(*[c for c in wide.columns if c not in names], F.inline(models))


def preds_cls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, model, Crop, y, yhat): the fertilizer rule applied to jittered N, P, K."""
    return preds_long(preds_cls_wide(spark, sf_dir)).select("obs_id", "model", "Crop", "y", "yhat")


def yield_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned yield rows with a baseline prediction: the mean yield of the row's crop.

    The per-crop means are a partial+final aggregate (no task holds a whole
    crop) joined back; AQE broadcasts them when they are small.
    """
    from furrow.operators.clean import yield_clean
    from furrow.operators.joins import attach_small
    yc = yield_clean(yield_raw(spark, sf_dir)).withColumnRenamed("yield_per_hectare", "y")
    means = yc.groupBy("Crop").agg(F.avg("y").alias("yhat"))
    return attach_small(yc, means, "Crop")


def preds_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, Crop, y, yhat): cleaned yield vs. the per-crop mean yield."""
    return yield_scored(spark, sf_dir).select("rec_id", "Crop", "y", "yhat")


N_PROB_CLASSES = 6


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, probability ARRAY<DOUBLE>) with forced ties on every 5th id."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"))
    raw = [h32("prob", F.col("row_id"), i) % 1000 + 1 for i in range(N_PROB_CLASSES)]
    raw[1] = F.when(F.col("row_id") % 5 == 0, raw[0]).otherwise(raw[1])
    arr = F.array(*[r.cast("double") for r in raw])
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return e.select("row_id", F.transform(arr, lambda x: x / total).alias("probability"))


def contribs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table (obs_id, feature, value, contribution) with zeros and ties."""
    ob = obs(spark, sf_dir)
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in CROP_FEATURES])
    long = ob.select("obs_id", F.inline(pairs))
    zero = h32("zero", F.col("obs_id"), F.col("feature")) % 9 == 0
    contrib = F.when(zero, F.lit(0.0)).otherwise(uniform(-1, 1, 2, "shap", F.col("obs_id"), F.col("feature")))
    return long.select("obs_id", "feature", "value", contrib.alias("contribution"))


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, event_id, error, ts) from ``events``; iterations are numbered by the operator."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias("run"), "event_id", F.col("value").alias("error"), "ts")
