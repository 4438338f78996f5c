"""Operators against direct computations on small frames."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators import chat, clean, encode, evaluate, profile, retrieval
from furrow.operators.ordering import indexed


def test_indexed_matches_row_number_any_partitioning(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "k": rng.permutation(500), "v": rng.normal(size=500)})
    pdf.loc[pdf.index[:200], "g"] = 0  # a hot group
    df = spark.createDataFrame(pdf)
    for buckets in (1, 3, 16):
        got = indexed(df.repartition(7), ["v", "k"], ["g"], n_buckets=buckets).toPandas()
        exp = pdf.sort_values(["g", "v", "k"]).assign(_idx=lambda d: d.groupby("g").cumcount())
        m = got.merge(exp, on="k", suffixes=("", "_e"))
        assert (m["_idx"] == m["_idx_e"]).all()


def test_exact_quantiles_match_numpy(spark):
    vals = [1.0, 2.0, 2.0, 2.0, 3.0, 10.0, 11.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = clean.exact_quantiles(df, "x", [0.25, 0.5, 0.99]).first()
    arr = np.array([v for v in vals if v is not None])
    for i, p in enumerate([0.25, 0.5, 0.99]):
        assert abs(q[f"q_{i}"] - np.quantile(arr, p)) < 1e-12


def test_yield_clean_drops_nan_null_zero(spark):
    df = spark.createDataFrame([(1, 10.0, 2.0), (2, float("nan"), 2.0), (3, None, 1.0), (4, 5.0, 0.0), (5, -1.0, 1.0)],
                               "id int, Production double, Area double")
    out = clean.yield_clean(df).collect()
    assert [r["id"] for r in out] == [1] and out[0]["yield_per_hectare"] == 5.0


def test_histogram_constant_and_max_value(spark):
    df = spark.createDataFrame([(7.0,)] * 4, "x double")
    h = profile.histogram(spark, df, "x", 30).orderBy("bin").toPandas()
    assert h["count"].sum() == 4 and h.loc[h["count"] > 0, "bin"].tolist() == [15]
    df2 = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double")
    h2 = profile.histogram(spark, df2, "x", 5).orderBy("bin").toPandas()
    assert h2["count"].tolist() == [1, 0, 1, 0, 1]  # max lands in the last (closed) bin


def test_standardize_population_std_and_constant(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "id int, a double, c double")
    out = {r["id"]: r for r in encode.standardize(df, ["a", "c"], ["id"]).collect()}
    assert out[1]["a"] == -1.0 and out[2]["a"] == 1.0 and out[1]["c"] == 0.0


def test_stratified_split_exact_proportions(spark):
    df = spark.createDataFrame([(i, "a" if i < 50 else "b") for i in range(60)], "id int, y string")
    s = encode.stratified_split(df, "y", "id").groupBy("y", "split").count().toPandas()
    d = {(r.y, r.split): r["count"] for _, r in s.iterrows()}
    assert d[("a", "test")] == 10 and d[("b", "test")] == 2


def test_classification_report_undefined_and_absent(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")]  # 'c' never predicted
    df = spark.createDataFrame([("m", y, p) for y, p in rows], "model string, y string, yhat string")
    rep = {r["label"]: r for r in evaluate.classification_report(df, ["model"]).collect()}
    assert rep["c"]["precision"] == 0.0 and rep["c"]["f1"] == 0.0
    assert rep["accuracy"]["f1"] == 0.5 and rep["accuracy"]["support"] == 4


def test_gate_threshold_is_strict_and_empty_store(spark):
    hits = spark.createDataFrame([(1, 0.5, 1, 10), (2, 0.4, 1, 11)], "qid int, distance double, rank int, did int")
    qs = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    g = {r["qid"]: r for r in retrieval.gate(hits, qs, 0.5).collect()}
    assert g[1]["mode"] == "general" and g[2]["mode"] == "rag" and g[3]["best_distance"] == 999.0


def test_knn_exact_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    docs = rng.normal(size=(120, 8))
    docs[:60] += 5.0  # two clusters so pruning has something to do
    qs = rng.normal(size=(15, 8))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(docs)], "did long, dvec array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)], "qid long, qvec array<double>")
    got = retrieval.knn(q, d, k=3, n_pivots=6).orderBy("qid", "rank").toPandas()
    for i, v in enumerate(qs):
        dist = ((docs - v) ** 2).sum(axis=1)
        exp = sorted(range(len(docs)), key=lambda j: (dist[j], j))[:3]
        assert got[got.qid == i]["did"].tolist() == exp


def test_chat_history_edit_clear(spark):
    h = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "x")],
                              "conv_id long, turn long, role string, content string")
    hist = {(r.conv_id, r.turn): r.history for r in chat.history_text(h).collect()}
    assert hist[(1, 0)] == "" and hist[(1, 1)] == "Farmer: hi\n\n"
    edits = spark.createDataFrame([(1, 0, "user", "new")], "conv_id long, turn long, role string, content string")
    e = chat.edit_and_replay(h, edits).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.content) for r in e] == [(1, "new"), (2, "x")]
    assert chat.clear(h, h.filter("conv_id = 2")).count() == 2
    assert {r.conv_id: r.turns for r in chat.turn_counts(h).collect()} == {1: 1, 2: 0}


def test_history_meets_blocks_and_only_asking_turns(spark, monkeypatch):
    monkeypatch.setattr(chat, "HISTORY_BLOCK", 4)
    rows = [(c, t, "user" if t % 3 else "assistant", None if t == 5 else f"{c}.{t}") for c in (1, 2) for t in range(23 if c == 1 else 1)]
    df = spark.createDataFrame(rows + [(3, 7, "user", "a"), (3, 7, "user", "b")], "conv_id long, turn long, role string, content string")

    def before(c, t, most=None):
        told = [r for r in rows if r[0] == c and r[1] < t][-most if most else 0:]
        return "".join(("Farmer: " if r[2] == "user" else "Advisor: ") + r[3] + "\n\n" for r in told if r[3])

    for most in (None, 3, 6):
        got = {(r.conv_id, r.turn): r.history for r in chat.history_text(df.filter("conv_id < 3"), max_turns=most).collect()}
        assert got == {(c, t): before(c, t, most) for c, t, _, _ in rows}
    asked = chat.history_text(df, asks=F.col("content").isin("1.20", "2.0", "b"))
    assert {(r.conv_id, r.turn): r.history for r in asked.collect()} == {(1, 20): before(1, 20), (2, 0): "", (3, 7): "Farmer: a\n\n"}
    assert chat.history_text(df.limit(0)).count() == 0


def test_regression_metrics_constant_target(spark):
    df = spark.createDataFrame([("g", 2.0, 1.0), ("g", 2.0, 3.0)], "grp string, y double, yhat double")
    r = evaluate.regression_metrics(df, ["grp"]).first()
    assert r["R2"] is None and r["RMSE"] == 1.0 and r["MAE"] == 1.0


def test_vocabulary_match_is_the_same_broadcast_and_joined(spark):
    from furrow.operators import vocab
    items = [("Rice",), ("Rice bran oil",), (" Kharif ",), ("ab",), ("b",), ("",), (None,), ("Überlänge Sorte",)]
    texts = [(1, "I grow rice bran oil"), (2, "kharif season"), (3, "xABx"), (4, ""), (5, None), (6, "nothing"),
             (7, "die überlänge sorte"), (8, "I grow rice bran oil")]
    m = spark.createDataFrame(texts, "id long, text string")
    for keep in (items, [i for i in items if i[0]]):
        voc = vocab.distinct_values(spark.createDataFrame(keep, "c string"), {"x": "c", "y": "c"})
        small, large = (vocab.attach_first_contained(m, "text", voc, ["x", "y"], strip={"y"}, broadcast_bytes=b)
                        for b in (10**6, 0))
        rows = sorted(map(tuple, large.collect()))
        assert rows == sorted(map(tuple, small.collect())) and len(rows) == len(texts)
        if keep is not items:
            low = {v.lower(): v for v, in keep if v}
            for i, t, x, _ in rows:
                hits = sorted(v for k, v in low.items() if t is not None and k in t.lower())
                assert x == (hits[0] if hits else min(low.values())), i


def test_positions_of_strings_with_a_common_prefix(spark):
    from furrow.operators import ordering
    vals = [None, None] + [f"common prefix of all keys {i * 7919 % 20011:05d}" for i in range(20_000)]
    df = spark.createDataFrame(list(enumerate(vals)), "k long, s string")
    sizes = ordering.with_buckets(df, "s", 500).groupBy("_b").count().toPandas()["count"]
    assert len(sizes) > 400 and sizes.max() < 400
    got = [r.k for r in ordering.indexed(df, ["s", "k"], n_buckets=500).orderBy("_idx").collect()]
    assert got == sorted(range(len(vals)), key=lambda i: (vals[i] is not None, vals[i] or "", i))


def test_exact_quantiles_by_group_on_ties_and_tiny_tables(spark):
    for n in (1, 2, 3, 7, 100, 101):
        x = np.round(np.random.default_rng(n).normal(size=n), 1)
        df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(x)], "g int, x double")
        for r in clean.exact_quantiles(df, "x", [0, 0.25, 0.99, 1], ["g"]).collect():
            assert np.allclose([r.q_0, r.q_1, r.q_2, r.q_3], np.quantile(x[r.g::2], [0, 0.25, 0.99, 1]))


def test_csv_keeps_padding(spark, tmp_path):
    from furrow.sources.tables import read_csv, write_csv
    df = spark.createDataFrame([("  Crop ", 'a "b"\nc'), (" rice\t", "x")], "k string, v string")
    write_csv(df, str(tmp_path / "t"))
    back = read_csv(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_knn_ignores_documents_without_a_vector(spark):
    from furrow.operators.retrieval import knn
    docs = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [1.0, 0.0])], "did long, dvec array<double>")
    q = spark.createDataFrame([(9, [0.0, 0.9])], "qid long, qvec array<double>")
    assert [r.did for r in knn(q, docs, k=2, n_pivots=1).orderBy("rank").collect()] == [1, 3]


def test_csv_splits_infers_and_keeps_bad_rows(spark, tmp_path):
    from furrow.sources import tables
    lines = ["a, b ,c,d,e,f"] + [f"{i},{i}.5,x{i},True,{i if i % 3 else ''},NA" for i in range(3000)]
    (tmp_path / "t.csv").write_text("\n".join([*lines, "1,2", "1,2,3,4,5,6,7"]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        t = tables.read_csv(spark, str(tmp_path / "t.csv"), infer=True, corrupt_column="bad")
        assert t.rdd.getNumPartitions() > 3
        assert dict(t.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "boolean", "e": "double", "f": "double", "bad": "string"}
        assert sorted(r.bad for r in t.where("bad is not null").collect()) == ["1,2", "1,2,3,4,5,6,7"]
        assert t.where("bad is null").agg(F.sum("a")).first()[0] == sum(range(3000)) and t.where("bad is null and e is null").count() == 1000
        (tmp_path / "q.csv").write_text('a,b\n1,"two\nlines"\n2,"say ""hi"""\n')
        q = tables.read_csv(spark, str(tmp_path / "q.csv"), infer=True)
        assert sorted(map(tuple, q.collect())) == [(1, "two\nlines"), (2, 'say "hi"')]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tables.column_types(spark.createDataFrame([], "x string"), ["x"]).first().type == "double"


def test_malformed_parameters_route_on(spark):
    from furrow.functions import text as tx
    p = tx.extract_params(F.col("t"))
    df = spark.createDataFrame([("recommend a crop, pH = 6.5.1",), ("recommend a crop, pH = 6.5",)], "t string")
    assert [r[0] for r in df.select(tx.params_error(p)).collect()] == [True, False]


def test_a_null_group_is_dropped_without_inlining_its_expression(spark):
    df = spark.range(40).select("id", F.when(F.col("id") % 7 < 6, F.md5(F.col("id").cast("string")).substr(1, 1)).alias("g"))
    df = df.join(F.broadcast(spark.range(50).withColumnRenamed("id", "k")), F.col("id") == F.col("k")) \
        .select("id", F.upper(F.concat("g", F.col("k").cast("string").substr(1, 0))).alias("g"))
    out = encode.kfold_assign(df, "g", "id", 3)
    want = {r["id"] for r in df.filter("g is not null").collect()}
    assert {r["id"] for r in out.collect()} == want and len(want) < 40
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("md5" not in line for line in text.split("\n") if "Filter" in line or "Join" in line)


def test_jittered_predictions_hash_once_and_join_before_they_are_expanded(spark, sf):
    from furrow.plans import q_eval
    from furrow.sources import fixtures as fx
    text = fx.preds_cls(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("concat_ws(:, rule_jitter5, N,") == 1
    wide, long = fx.preds_cls_wide(spark, sf), fx.preds_cls(spark, sf)
    assert long.count() == 3 * wide.count() and long.columns == ["obs_id", "model", "Crop", "y", "yhat"]
    tree = q_eval._folded(spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert min(i for i, line in enumerate(tree) if "Generate" in line) < min(i for i, line in enumerate(tree) if "Join" in line)


def test_joins_of_the_field_records_are_dealt_out_by_row_count(spark, sf, monkeypatch):
    from furrow.sources import fixtures
    plain = fixtures.yield_raw(spark, sf)
    assert "RepartitionByExpression" not in plain._jdf.queryExecution().optimizedPlan().toString()
    rows = plain.count()
    monkeypatch.setattr(fixtures, "JOIN_ROWS", rows // 40)
    dealt = fixtures.yield_raw(spark, sf)
    parts = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // (rows // 40))
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    for key in ("o_custkey", "l_orderkey", "l_partkey"):
        assert any(f"[{key}#" in line and line.rstrip().endswith(f", {parts}") for line in plan.split("\n") if "RepartitionByExpression" in line), plan
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
