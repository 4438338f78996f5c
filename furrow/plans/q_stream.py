"""Queries: Structured Streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.plans.q_text import sql_intent, sql_params
from furrow.plans.registry import register
from furrow.plans.sqlfrag import with_views
from furrow.sources.tables import table
from furrow.streaming import chat_stream


def _conv_stream(spark, sf):
    schema = table(spark, sf, "conversations").schema
    # A glob, because the source takes a table that is one file only in that form; folders of files match as well.
    return chat_stream.read_stream(spark, f"{sf.rstrip('/')}/conversations.parque[t]", schema)


@register("stream_route", with_views("chat") + f"""
SELECT conv_id, turn, role, {sql_intent('content')} AS intent, z.* EXCLUDE (conv_id, turn), 
  (z.N IS NULL OR z.P IS NULL OR z.K IS NULL OR z.temperature IS NULL OR z.humidity IS NULL OR z.ph IS NULL
   OR z.rainfall IS NULL) AS error
FROM chat JOIN (SELECT conv_id, turn, {sql_params('content')} FROM chat) z USING (conv_id, turn)""", ops="L1")
def stream_route(spark, sf):
    """Routing/extraction of arriving conversation messages; equals the batch result."""
    out = chat_stream.run_to_table(spark, chat_stream.route_columns(_conv_stream(spark, sf)), "append", "route")
    return out.select("conv_id", "turn", "role", "intent", "params.*", "error")


@register("stream_chat_state", with_views("chat") + f"""
SELECT conv_id, count(*) AS n_messages, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS n_user,
  arg_max(CASE WHEN role = 'user' THEN {sql_intent('content')} END, CASE WHEN role = 'user' THEN turn END) AS last_user_intent
FROM chat GROUP BY conv_id""", ops="L2")
def stream_chat_state(spark, sf):
    """Per-conversation state of a streaming aggregate: each micro-batch upserts the conversations it changed (update mode)."""
    state = chat_stream.conversation_state(_conv_stream(spark, sf))
    return chat_stream.run_to_table(spark, state, "update", "state")


@register("stream_score", None, ops="L3")
def stream_score(spark, sf):
    """Score observations arriving as a stream with the fitted crop pipeline."""
    from furrow.plans.q_models import crop_scorer
    from furrow.session import scratch_path
    from furrow.sources import fixtures as fx
    model = crop_scorer(spark, sf)
    path = scratch_path(spark, "obs-stream-src")
    fx.obs(spark, sf).write.parquet(path)
    src = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    scored = chat_stream.score_stream(model, src).select("obs_id", "prediction")
    return chat_stream.run_to_table(spark, scored, "append", "score")
