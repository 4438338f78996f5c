"""Streaming twins equal their batch results."""

from furrow.plans import q_stream
from furrow.sources import fixtures as fx
from furrow.functions import text as tx
from pyspark.sql import functions as F


def test_stream_route_equals_batch(spark, sf):
    s = q_stream.stream_route(spark, sf).select("conv_id", "turn", "intent", "error")
    b = fx.chat(spark, sf).select("conv_id", "turn", tx.detect_intent(F.col("content")).alias("intent"),
                                  tx.params_error(tx.extract_params(F.col("content"))).alias("error"))
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_stream_state_counts(spark, sf):
    s = q_stream.stream_chat_state(spark, sf)
    b = fx.chat(spark, sf).groupBy("conv_id").count()
    j = s.join(b, "conv_id")
    assert j.count() == b.count() and j.filter("n_messages <> count").count() == 0


def test_route_reads_every_file_of_a_table_folder(spark, sf, tmp_path):
    from furrow.plans import q_stream
    from furrow.sources.tables import table
    src = table(spark, sf, "conversations")
    src.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    assert q_stream.stream_route(spark, str(tmp_path)).count() == src.count()


def test_state_over_batches_replays_and_compaction(spark, sf, tmp_path):
    from furrow.sources.tables import table
    from furrow.streaming import chat_stream
    src = table(spark, sf, "conversations")
    src.repartition(5).write.parquet(str(tmp_path / "c"))
    want = sorted(map(tuple, chat_stream.conversation_state(src).collect()))
    stream = chat_stream.conversation_state(chat_stream.read_stream(spark, str(tmp_path / "c"), src.schema))
    state = chat_stream.StateTable(spark, str(tmp_path / "state"), "conv_id")
    assert state.read(stream.schema).count() == 0
    seen = []

    def keep(rows, batch):
        seen.append((batch, rows.collect()))
        state.upsert(spark.createDataFrame(seen[-1][1], stream.schema), batch)

    (stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ckpt")).outputMode("update")
     .trigger(availableNow=True).start().awaitTermination())
    assert len(seen) == 5 and sum(len(rows) for _, rows in seen) > len(want)
    for batch, rows in (seen[2], seen[4], seen[4]):  # batches that are run again
        state.upsert(spark.createDataFrame(rows, stream.schema), batch)
    (tmp_path / "state" / "batch=99").mkdir()  # a batch that never finished
    assert sorted(map(tuple, state.read(stream.schema).collect())) == want
    state.compact(stream.schema)
    assert state._batches() == [seen[-1][0]] and sorted(map(tuple, state.read(stream.schema).collect())) == want
    state.compact(stream.schema)
    assert not [q for q in spark.streams.active]


def test_stream_scores_equal_batch_scores(spark, sf):
    from furrow.plans import q_models
    s = q_stream.stream_score(spark, sf)
    b = q_models.crop_scorer(spark, sf).transform(fx.obs(spark, sf)).select("obs_id", "prediction")
    assert s.count() == b.count() and s.exceptAll(b).isEmpty()
