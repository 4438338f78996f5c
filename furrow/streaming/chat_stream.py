"""Streaming message routing, per-conversation state and record scoring.

The batch column expressions are reused unchanged on a streaming DataFrame:
``readStream.parquet`` -> routing/extraction (stateless, append) and
``groupBy(conv_id)`` aggregates (stateful, update mode). Sources are read
with ``trigger(availableNow=True)`` so a run processes what is there and
stops; the checkpoint goes to the session's shared checkpoint folder.

State leaves the stream through ``StateTable``: every micro-batch writes the
conversations it changed, in hash buckets, to a folder of its own that is
named by the batch id and replaced as a whole. A batch that is run again after
a failure overwrites its folder with the same rows, so the table never counts
it twice; a reader takes each conversation's row of the latest batch. ``compact``
folds finished batches into one. Nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions import text as tx
from furrow.session import drop_path, drop_scratch, scratch_path, written


def read_stream(spark: SparkSession, folder: str, schema, file_glob: str | None = None,
                max_files: int = 1) -> DataFrame:
    """Stream the parquet files of a folder (optionally only those matching ``file_glob``)."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    return r.parquet(folder)


def route_columns(messages: DataFrame) -> DataFrame:
    """Stateless: intent + extracted parameters for each arriving message."""
    p = tx.extract_params(F.col("text"))
    return messages.select("conv_id", "turn", "role", tx.detect_intent(F.col("text")).alias("intent"),
                           p.alias("params"), tx.params_error(p).alias("error"))


def conversation_state(messages: DataFrame) -> DataFrame:
    """Stateful: per conversation, message count, user turns and the latest user intent."""
    m = messages.withColumn("intent", tx.detect_intent(F.col("text")))
    return m.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.sum((F.col("role") == "user").cast("long")).alias("n_user"),
        F.max_by(F.when(F.col("role") == "user", F.col("intent")),
                 F.when(F.col("role") == "user", F.col("turn"))).alias("last_user_intent"))


def run_to_table(spark: SparkSession, df: DataFrame, output_mode: str, name: str) -> DataFrame:
    """Run a streaming query to completion (availableNow) into parquet (append) or a state table (update); return the result."""
    ckpt = scratch_path(spark, f"stream-{name}-ckpt")
    if output_mode == "append":
        out = scratch_path(spark, f"stream-{name}-out")
        q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.parquet(out)
    state = StateTable(spark, scratch_path(spark, f"stream-{name}-state"), df.columns[0])
    q = (df.writeStream.foreachBatch(state.upsert).option("checkpointLocation", ckpt)
         .outputMode(output_mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return state.read(df.schema)


class StateTable:
    """The latest row of every key, fed by micro-batches of an update-mode stream; each batch is applied exactly once."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    def upsert(self, rows: DataFrame, batch_id: int) -> None:
        """Writes the changed rows of a batch; idempotent by batch id."""
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def _batches(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return []
        names = [f.getPath() for f in store.listStatus(folder)]
        done = [p.getName() for p in names if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done if n.startswith("batch="))

    def read(self, schema: T.StructType) -> DataFrame:
        """Each key's row of the latest finished batch: one aggregate on the key, whatever the number of batches."""
        batches = self._batches()
        if not batches:
            return self.spark.createDataFrame([], schema)
        rows = (self.spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", self.path)
                .parquet(*[f"{self.path}/batch={b}" for b in batches]))
        value = F.struct(*[c for c in schema.names if c != self.key])
        best = rows.groupBy(self.key).agg(F.max_by(value, "batch").alias("_v"))
        return best.select(*[F.col(self.key) if c == self.key else F.col(f"_v.`{c}`").alias(c) for c in schema.names])

    def compact(self, schema: T.StructType) -> None:
        """Folds all finished batches into the folder of the latest one; readers see the same rows before and after.

        Call it between runs of the stream. The folded rows are written aside first, so a failure leaves the batches as they were."""
        batches = self._batches()
        if len(batches) < 2:
            return
        folded = written(self.read(schema), "state-fold")
        folded.write.mode("overwrite").parquet(f"{self.path}/batch={batches[-1]}")
        for b in batches[:-1]:
            drop_path(self.spark, f"{self.path}/batch={b}")
        drop_scratch(folded)


def score_stream(model, records: DataFrame) -> DataFrame:
    """Apply a fitted PipelineModel to a streaming DataFrame (stateless, append)."""
    return model.transform(records)
