"""Chat formatting from event logs, in native DataFrame functions only.

An event is (conv_id, seq, message_id, kind, role, text):

* ``message`` opens a message with a text; ``delta`` appends to it; ``edit`` replaces its text; ``regenerate`` drops its text
  (null or given text starts the new one, following deltas continue it); ``delete`` withdraws it. Other kinds are ignored.

``fold_events`` groups the log by conversation and message, sorts by sequence number and folds every message in one array
expression: its final text is the concatenation from its last resetting event on. ``render`` then writes a conversation as

    ### role: text</turn>

per turn. Inside roles and texts the characters the template needs are escaped reversibly (``\\`` as ``\\b``, ``#`` as
``\\h``, ``<`` as ``\\l``, and in roles ``:`` as ``\\c``), so no text can forge a turn. The loss mask is given as one run per turn
(``skip`` characters outside, then ``take`` characters under the loss, which are the escaped text of trained roles).
``read_back`` recovers turns and masked text from the formatted string and the mask alone.

The two groupings have partial aggregates: first per (conversation, message), then per conversation, so a hot conversation is
folded by many tasks and only its final texts meet in the one row that a rendered conversation is.

Defined edge cases: null text is empty, null role is the empty role, null kind is ``message``; a null seq sorts first; ties go
by role, then text; repeated ``message`` events of one message_id are messages of their own, where later deltas and edits apply
to the last; events without an opening ``message`` open it themselves; a null conv_id is a conversation; extra columns are
ignored; an empty log gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Order matters: the escape character first, and last when unescaping.
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c")]
TURN_END = "</turn>\n"
RESETS = ["message", "edit", "regenerate", "delete"]


def escape(c: Column, pairs: list[tuple[str, str]] | None = None) -> Column:
    for raw, safe in pairs or ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column, pairs: list[tuple[str, str]] | None = None) -> Column:
    for raw, safe in reversed(pairs or ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, seq, role, text), seq being that of the event that opened the message."""
    e = events.select(
        "conv_id", "message_id", F.col("seq").cast("long").alias("seq"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce("kind", F.lit("message")).alias("kind"),
    ).where(F.col("kind").isin(*RESETS, "delta"))
    folded = e.groupBy("conv_id", "message_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "role", "text", "kind"))).alias("ev"))
    opens = F.filter("ev", lambda x: x["kind"] == "message")
    last_reset = F.size("ev") - F.array_position(
        F.transform(F.reverse("ev"), lambda x: x["kind"].isin(RESETS)), True).cast("int") + 1
    folded = folded.select(
        "conv_id", F.when(F.size(opens) > 0, opens).otherwise(F.slice("ev", 1, 1)).alias("opens"),
        F.when(F.size("ev") >= last_reset, F.slice("ev", F.greatest(last_reset, F.lit(1)), F.size("ev")))
        .otherwise(F.col("ev")).alias("tail"))
    text = F.array_join(F.transform("tail", lambda x: x["text"]), "")
    gone = F.element_at("tail", 1)["kind"] == "delete"
    older = F.transform(F.slice("opens", 1, F.size("opens") - 1), lambda x: F.struct(x["seq"].alias("seq"), x["role"].alias("role"),
                                                                                      x["text"].alias("text")))
    last = F.element_at("opens", -1)
    newest = F.array(F.struct(last["seq"].alias("seq"), last["role"].alias("role"), text.alias("text")))
    return folded.select("conv_id", F.inline(F.when(gone, older).otherwise(F.concat(older, newest))))


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: (conv_id, formatted, loss_mask array<struct<skip, take>>)."""
    m = messages.select("conv_id", "seq", "role", "text")
    turns = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text"))).alias("turns"))
    head = lambda t: F.concat(F.lit("### "), escape(t["role"], ROLE_ESCAPES), F.lit(": "))
    pieces = turns.select(
        "conv_id", F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(TURN_END))).alias("pieces"),
        F.transform("turns", lambda t: F.struct(
            F.length(head(t)).alias("skip"),
            F.when(t["role"] == trained_role, F.length(escape(t["text"]))).otherwise(0).alias("take"))).alias("loss_mask"))
    return pieces.select("conv_id", F.array_join("pieces", "").alias("formatted"), "loss_mask")


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<struct<role, text>>, loss_text) recovered from the formatted text and its mask."""
    cut = rendered.select("conv_id", "formatted", "loss_mask", F.split("formatted", TURN_END).alias("parts"))
    cut = cut.select("conv_id", "formatted", "loss_mask", F.slice("parts", 1, F.size("parts") - 1).alias("parts"))
    turns = F.transform("parts", lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, 5, 2**31 - 1), ": ", 1), ROLE_ESCAPES).alias("role"),
        unescape(p.substr(F.locate(": ", p) + 2, F.lit(2**31 - 1))).alias("text")))
    loss = F.array_join(F.zip_with("parts", "loss_mask", lambda p, m: unescape(p.substr(m["skip"] + 1, m["take"]))), "")
    return cut.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))
