"""Queries: conversations, store build, category counts, training curve, CSV round trip
(SURVEY 2.A, 2.E, 2.H, 2.I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import chat, store
from furrow.plans.registry import register
from furrow.plans.sqlfrag import with_views
from furrow.session import scratch_path, written
from furrow.sources import fixtures as fx
from furrow.sources import tables


@register("chat_history", with_views("chat") + """
SELECT conv_id, turn, coalesce(string_agg(CASE WHEN role = 'user' THEN 'Farmer' ELSE 'Advisor' END || ': ' || content || chr(10) || chr(10), '')
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM chat""",
          ops="H7")
def chat_history(spark, sf):
    return chat.history_text(fx.chat(spark, sf)).select("conv_id", "turn", "history")


_EDIT_SQL = with_views("chat") + """
, n AS (SELECT conv_id, count(*) AS n FROM chat GROUP BY conv_id),
e AS (SELECT c.conv_id, c.turn, 'user' AS role, 'EDITED: ' || c.content AS content FROM chat c JOIN n USING (conv_id)
      WHERE c.turn = floor(n.n / 2))
SELECT c.conv_id, c.turn, c.role, c.content FROM chat c LEFT JOIN e ON c.conv_id = e.conv_id
WHERE e.turn IS NULL OR c.turn < e.turn
UNION ALL SELECT conv_id, turn, role, content FROM e"""


@register("chat_edit", _EDIT_SQL, ops="I2 I3")
def chat_edit(spark, sf):
    h = fx.chat(spark, sf)
    return chat.edit_and_replay(h, chat.edits_at_middle(h)).select("conv_id", "turn", "role", "content")


@register("chat_clear", with_views("chat") + """
SELECT * FROM chat WHERE conv_id NOT IN (SELECT conv_id FROM chat WHERE role = 'system')""", ops="I4")
def chat_clear(spark, sf):
    h = fx.chat(spark, sf)
    return chat.clear(h, h.filter(F.col("role") == "system"))


@register("chat_export", with_views("chat") + """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'You' ELSE 'AI Advisor' END || ': ' || content AS line FROM chat""",
          ops="A13")
def chat_export(spark, sf):
    return chat.export_lines(fx.chat(spark, sf))


@register("chat_turns", with_views("chat") + "SELECT conv_id, CAST(count(*) // 2 AS BIGINT) AS turns FROM chat GROUP BY conv_id",
          ops="E15")
def chat_turns(spark, sf):
    return chat.turn_counts(fx.chat(spark, sf))


@register("category_counts", with_views("corpus") + """
SELECT category, count(*) AS n_docs FROM corpus GROUP BY ROLLUP (category)""", ops="E14")
def category_counts(spark, sf):
    return store.category_counts(fx.corpus(spark, sf))


@register("kb_build", with_views("kb") + """
SELECT id, category, topic, CAST((row_number() OVER (ORDER BY id) - 1) // 10 AS BIGINT) AS batch FROM kb""",
          ops="A11 A15 H8")
def kb_build(spark, sf):
    return store.with_batches(fx.kb(spark, sf).select("id", "category", "topic"), "id")


@register("training_curve", with_views("train_log") + """
, t AS (SELECT run, error, ts, row_number() OVER (PARTITION BY run ORDER BY event_id) AS iteration FROM train_log)
SELECT a.run, a.iteration, a.error, b.error AS prev_error, b.error - a.error AS improvement,
       date_diff('microsecond', b.ts, a.ts) / 1000.0 AS ms_since_prev
FROM t a LEFT JOIN t b ON a.run = b.run AND b.iteration = a.iteration - 1""", ops="A16")
def training_curve(spark, sf):
    return store.training_curve(fx.train_log(spark, sf))


PADDED = {c: f"  {c} " for c in fx.OBS_NUMERIC + ["Soil", "Crop", "Fertilizer"]}


@register("scan_csv_roundtrip", with_views("obs") + "SELECT * FROM obs", ops="A1 A2 A3 A6")
def scan_csv_roundtrip(spark, sf):
    """Write observations as CSV with padded headers and cells, read back with a schema."""
    o = fx.obs(spark, sf)
    padded = o.select(F.col("obs_id").alias(" obs_id"),
                      *[(F.concat(F.lit(" "), F.col(c), F.lit("\t")) if c in ("Soil", "Crop", "Fertilizer")
                         else F.col(c)).alias(PADDED[c]) for c in PADDED])
    path = scratch_path(spark, "csv")
    tables.write_csv(padded, path)
    schema = o.schema
    back = tables.read_csv(spark, path, schema=schema, strip_header=True, strip_cells=True)
    return back.select(*o.columns)


_CSV = [("rec_id", "bigint"), ("Crop", "string"), ("Season", "string"), ("State_Name", "string"), ("Temperature", "double"),
        ("Area", "double"), ("Crop_Year", "bigint")]


@register("csv_inferred_types", with_views("yield_raw") + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {f"CASE WHEN count(*) = count({c}) THEN 'bigint' ELSE 'double' END" if t == "bigint" else f"'{t}'"} AS "type",
        count({c}) AS n_values, count(*) - count({c}) AS n_missing,
        (SELECT count(*) FROM yield_raw WHERE rec_id % 50 = 0) AS n_bad_rows FROM yield_raw""" for c, t in _CSV), ops="A1")
def csv_inferred_types(spark, sf):
    """Field records as CSV lines, some of them cut short: the types inferred over all whole rows, missing cells and bad rows."""
    y = fx.yield_raw(spark, sf).select(*[c for c, _ in _CSV])
    cut = y.where("rec_id % 50 = 0").select(F.concat_ws(",", F.col("rec_id").cast("string"), F.lit("cut")).alias("value"))
    path = scratch_path(spark, "csv-lines")
    y.select(F.to_csv(F.struct(*y.columns)).alias("value")).unionByName(cut).write.text(path)
    back = written(tables.read_csv(spark, path, names=y.columns, corrupt_column="bad"), "csv-rows")  # parsed once
    whole = back.where("bad is null").drop("bad")
    n_bad = back.agg(F.count_if(F.col("bad").isNotNull()).alias("n_bad_rows"))  # one row
    return tables.column_types(whole, y.columns).crossJoin(F.broadcast(n_bad))
