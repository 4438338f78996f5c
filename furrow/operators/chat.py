"""Conversation tables: history text, edit-and-replay, clearing, export, turn counts.

A conversation is rows (conv_id, turn, role, content[, used_model, response_mode]).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.joins import attach_small
from furrow.operators.ordering import indexed

# Speaker labels used in prompts and exports.
PROMPT_USER, PROMPT_OTHER = "Farmer", "Advisor"
EXPORT_USER, EXPORT_OTHER = "You", "AI Advisor"


def _speaker(role_col: str, user_label: str, other_label: str):
    return F.when(F.col(role_col) == "user", F.lit(user_label)).otherwise(F.lit(other_label))


#: Turns in one block of a conversation.
HISTORY_BLOCK = 128


def history_text(df: DataFrame, max_turns: int | None = None, asks: Column | None = None) -> DataFrame:
    """'Farmer: ...\\n\\nAdvisor: ...\\n\\n' of all turns strictly before it, for every turn where ``asks`` holds (default: all turns).

    Returns the asking rows with a column ``history``. A conversation is cut into blocks of ``HISTORY_BLOCK`` consecutive turns, each an
    array of its pieces in order; an asking turn meets the blocks at or before its own by an equality join on (conversation, block) and
    keeps the earlier pieces. So texts are built for asking turns alone, and a hot conversation spreads over its blocks. A full
    history is as long as what came before; ``max_turns`` bounds it to the last N turns and the blocks met to those that hold them.

    Turns are ordered by turn, then role and content; a null content is left out, rows without a conversation see no history.
    """
    content = F.concat(_speaker("role", PROMPT_USER, PROMPT_OTHER), F.lit(": "), F.col("content"), F.lit("\n\n"))
    asks = F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))
    rows = indexed(df.withColumn("_asks", asks), ["turn", "role", "content"], ["conv_id"], idx_col="_at")
    blocks = rows.select("conv_id", F.floor(F.col("_at") / HISTORY_BLOCK).alias("_block"), "_at", content.alias("_piece")) \
        .groupBy("conv_id", "_block").agg(F.sort_array(F.collect_list(F.struct("_at", "_piece"))).alias("_pieces"))
    first = F.lit(0) if max_turns is None else F.greatest(F.col("_at") - max_turns, F.lit(0))
    asking = rows.filter("_asks").withColumn("_from", first.cast("long"))
    met = asking.filter("_at > 0").select("conv_id", "_at", "_from", F.explode(F.sequence(
        F.floor(F.col("_from") / HISTORY_BLOCK), F.floor((F.col("_at") - 1) / HISTORY_BLOCK))).alias("_block"))
    earlier = F.filter("_pieces", lambda p: (p["_at"] < F.col("_at")) & (p["_at"] >= F.col("_from")))
    parts = met.join(blocks, ["conv_id", "_block"]) \
        .select("conv_id", "_at", "_block", F.array_join(F.transform(earlier, lambda p: p["_piece"]), "").alias("_text"))
    texts = parts.groupBy("conv_id", "_at").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("_block", "_text"))), lambda p: p["_text"]), "").alias("history"))
    return asking.join(texts, ["conv_id", "_at"], "left").withColumn("history", F.coalesce("history", F.lit(""))) \
        .select(*df.columns, "history")


def append_turns(history: DataFrame, new_turns: DataFrame) -> DataFrame:
    return history.unionByName(new_turns, allowMissingColumns=True)


def edit_and_replay(history: DataFrame, edits: DataFrame) -> DataFrame:
    """Cut each edited conversation before the edited turn and append the edit.

    ``edits`` has (conv_id, turn, role, content): the new turn replaces the
    one at ``turn`` and everything after it. Conversations without an edit
    are kept whole.
    """
    cut = edits.select("conv_id", F.col("turn").alias("_cut"))
    h = history.join(cut, "conv_id", "left").filter(F.col("_cut").isNull() | (F.col("turn") < F.col("_cut")))
    return append_turns(h.drop("_cut"), edits)


def clear(history: DataFrame, cleared: DataFrame) -> DataFrame:
    """Drop every turn of the cleared conversations."""
    return history.join(cleared.select("conv_id").distinct(), "conv_id", "left_anti")


def export_lines(df: DataFrame) -> DataFrame:
    """One line per turn, 'You: ...' / 'AI Advisor: ...'; joined by a blank line they form the export."""
    line = F.concat(_speaker("role", EXPORT_USER, EXPORT_OTHER), F.lit(": "), F.col("content"))
    return df.select("conv_id", "turn", line.alias("line"))


def write_export(df: DataFrame, path: str) -> None:
    """Write each conversation as text (blank line between turns), one folder per conversation.

    Rows are clustered by conversation and sorted by turn inside each task;
    no conversation is ever gathered into a single row.
    """
    lines = export_lines(df)
    out = lines.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    out.select("conv_id", F.concat(F.col("line"), F.lit("\n")).alias("value")) \
        .write.mode("overwrite").partitionBy("conv_id").text(path)


def turn_counts(df: DataFrame) -> DataFrame:
    """Conversation turns = messages // 2."""
    return df.groupBy("conv_id").agg(F.floor(F.count(F.lit(1)) / 2).cast("long").alias("turns"))


def edits_at_middle(history: DataFrame, prefix: str = "EDITED: ") -> DataFrame:
    """Data-derived edits: for each conversation, re-ask its middle turn's user text."""
    n = history.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"))
    mid = attach_small(history, n, "conv_id").filter(F.col("turn") == F.floor(F.col("_n") / 2))
    return mid.select("conv_id", "turn", F.lit("user").alias("role"),
                      F.concat(F.lit(prefix), F.col("content")).alias("content"))
