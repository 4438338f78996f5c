"""Edge cases of the column functions (FIXTURES.md section 3)."""

import math

from pyspark.sql import functions as F

from furrow.functions import rules, text
from furrow.functions.vectors import sq_l2


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols[n] for n in names)], names) if names else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_half_even_class_rounding(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-3.0,), (99.0,)], ["p"])
    got = [r[0] for r in df.select(rules.round_clip_class(F.col("p"), 22)).collect()]
    assert got == [0, 2, 2, 0, 21]


def test_strip_removes_tabs_and_newlines(spark):
    assert one(spark, text.strip_ws(F.col("s")), s=" \tKharif \n") == "Kharif"
    assert one(spark, F.trim(F.col("s")), s="Kharif\t") == "Kharif\t"  # why trim is not enough


def test_capitalize_lowercases_tail(spark):
    assert one(spark, text.capitalize(F.col("s")), s="rICE paddy") == "Rice paddy"


def test_limiting_nutrient_ties_and_bounds(spark):
    fmap = F.create_map(*[F.lit(x) for x in ["N_low", "Urea", "P_low", "DAP", "K_low", "MOP", "balanced", "Good NPK"]])
    rows = [(5.0, 5.0, 5.0), (20.0, 9.9, 9.9), (10.0, 20.0, 30.0), (30.0, 20.0, 9.0)]
    df = spark.createDataFrame(rows, ["N", "P", "K"])
    got = [r[0] for r in df.select(rules.limiting_nutrient(F.col("N"), F.col("P"), F.col("K"), fmap)).collect()]
    assert got == ["Urea", "DAP", "Good NPK", "MOP"]


def test_rating_band_edges(spark):
    df = spark.createDataFrame([(5.0,), (4.99,), (2.5,), (1.0,), (0.99,)], ["y"])
    got = [r[0] for r in df.select(rules.yield_rating(F.col("y"))).collect()]
    assert got == ["Excellent", "Good", "Good", "Average", "Low"]


def test_advisories_edges(spark):
    df = spark.createDataFrame([(38.0, 30.0, 20.0), (38.1, 29.9, 19.9), (14.9, 50.0, 50.0), (None, 50.0, 50.0)],
                               "t double, h double, m double")
    got = [len(r[0]) for r in df.select(rules.field_advisories(F.col("t"), F.col("h"), F.col("m"))).collect()]
    assert got == [0, 3, 1, 0]


def test_deficiency(spark):
    df = spark.createDataFrame([(4.0, 5.0, 4.9), (5.0, 5.0, 5.0)], ["N", "P", "K"])
    got = [r[0] for r in df.select(rules.deficiency_list(F.col("N"), F.col("P"), F.col("K"))).collect()]
    assert got == ["Nitrogen (N), Potassium (K)", "adequate"]


def test_intent_order_and_predict_rule(spark):
    msgs = ["What crop suits me?", "predict fertilizer please", "which fertilizer is best",
            "predict yield for rice", "tell me a joke", "Predict crop and fertilizer"]
    df = spark.createDataFrame([(m,) for m in msgs], ["t"])
    got = [r[0] for r in df.select(text.detect_intent(F.col("t"))).collect()]
    assert got == ["crop", "fertilizer", "general", "yield", "general", "crop"]


def test_params_quirks_and_malformed(spark):
    df = spark.createDataFrame([("temp=25",), ("rain=120",), ("ph=6.5.1",), ("hello",), ("it is 30 C",)], ["t"])
    rows = df.select(text.extract_params(F.col("t")).alias("p")).select("p.*",
                                                                        text.params_error(F.col("p")).alias("e")).collect()
    assert rows[0]["P"] == 25.0 and rows[0]["temperature"] == 25.0        # "tem-p=25" also fills P
    assert rows[1]["N"] == 120.0 and rows[1]["rainfall"] == 120.0          # "rai-n=120" also fills N
    assert rows[2]["ph"] is None and rows[2]["e"] is True                  # malformed number -> error
    assert rows[3]["N"] == 60.0 and rows[3]["rainfall"] == 100.0 and rows[3]["e"] is False
    assert rows[4]["temperature"] == 30.0


def test_first_contained_substring_quirk(spark):
    vocab = ["maize", "rice"]
    df = spark.createDataFrame([("what is the price",), ("nothing",)], ["t"])
    got = [r[0] for r in df.select(text.first_contained(F.col("t"), vocab)).collect()]
    assert got == ["rice", "maize"]


def test_split_response_three_vs_four(spark):
    df = spark.createDataFrame([("A. B! C?",), ("A. B. C. D.",)], ["t"])
    rows = df.select(text.split_response(F.col("t")).alias("r")).select("r.*").collect()
    assert rows[0]["summary"] == "A. B! C?" and rows[0]["detail"] is None
    assert rows[1]["summary"] == "A. B." and rows[1]["detail"] == "C. D."


def test_preview(spark):
    assert one(spark, text.preview(F.col("t"), 5), t="abcdef") == "abcde..."
    assert one(spark, text.preview(F.col("t"), 5), t="abcde") == "abcde"


def test_sq_l2(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], ["a", "b"])
    assert df.select(sq_l2(F.col("a"), F.col("b"))).first()[0] == 25.0


def test_first_contained_ends_at_the_first_hit(spark):
    df = spark.createDataFrame([("Rice and MAIZE",), (None,), ("none",)], "t string")
    got = df.select(text.first_contained(F.col("t"), ["Maize", "rice"]).alias("a"), text.first_contained(F.col("t"), []).alias("b"),
                    text.first_contained(F.col("t"), [" rice\t", "x"], strip_items=True).alias("c"))
    assert [tuple(r) for r in got.collect()] == [("Maize", None, " rice\t"), ("Maize", None, " rice\t"), ("Maize", None, " rice\t")]
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()  # no item is tested after a hit, no text lower-cased an item


def test_vocabulary_keys_are_not_made_once_a_text(spark):
    from furrow.operators import vocab
    m = spark.createDataFrame([("in kharif",)], "text string")
    voc = vocab.distinct_values(spark.createDataFrame([(" Kharif ",), ("Rabi",)], "c string"), {"x": "c"})
    out = vocab.attach_first_contained(m, "text", voc, ["x"], strip={"x"})
    assert out.first()["x"] == " Kharif "
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("regexp" not in line and "lower" not in line for line in plan.split("\n") if "filter(" in line)
