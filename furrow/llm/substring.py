"""Substring dedup by level-wise doubling.

A window is a run of consecutive words of one document. Only windows that repeat at one length are extended to twice that
length:

1. *Half length* (25 words of 50). Of the 26 half windows inside every full window the one with the smallest hash is its
   anchor (equal windows have equal anchors), so about 7 % of all positions represent every window without loss. Anchors
   found in a single document are dropped.
2. *Full length* (50 words). Full windows whose anchor survived are hashed (96 bits); the smallest doc_id per window
   decides which documents repeat an earlier one. Words covered by such windows are removed.
3. *Longer* (``repeat_lengths``): all full windows that repeat are extended to 100, 200, ... words where both halves repeat;
   a level keeps the windows that repeat and extends those alone, until no candidate survives.

Exact copies of a whole text are recognised by digest first; only the smallest doc_id of a copy group takes part as a
candidate at full length, so a group holding a third of all rows costs one member.

Every step is a shuffle on a hash with partial aggregation (min, max) or a join that AQE can split; texts are shuffled once
(by doc_id) and the exchange is shared by both joins. No text, window or list is gathered on the driver.

Defined edge cases: null or short texts (fewer words than the window) keep all words; a null doc_id is no document, its row
is returned whole and removes nothing elsewhere; rows that share a doc_id are one document (their windows do not remove each
other); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.words import (
    Words, as_long, chunks, distinct_per_owner, lists, owner_key, window_hashes, window_inside,
)
from furrow.session import drop_scratch, written


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    step, out = 1, x
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        step *= 2
    rest = width - step
    if rest:
        out = np.minimum(out[:-rest], out[rest:]) if len(out) > rest else out[:0]
    return out


def _anchor_values(words: Words, hashes: np.ndarray, length: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor hash, document index) of every window of `length` words that lies within one document."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = _sliding_min(window_hashes(hashes, half), length - half + 1)
    ok = window_inside(words.counts, words.word_offs, len(hashes), length)
    return low[ok], words.doc[:len(low)][ok]


def _emit(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def _ids(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


_WINDOW = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("doc_id", pa.int64())])


def _anchors(length: int, half: int, owner_id: str):
    """(anchor, `owner_id` of its row), distinct per row."""
    schema = pa.schema([("h", pa.int64()), (owner_id, pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, "text"):
                w = Words(c.column("text"))
                values, owner = _anchor_values(w, w.hashes(), length, half)
                keep = distinct_per_owner(values, owner)
                yield _emit(schema, as_long(values[keep]), _ids(c, owner_id)[owner[keep]])
    return run


def _windows(length: int, half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, "text"):
                w = Words(c.column("text"))
                h = w.hashes()
                values, owner = _anchor_values(w, h, length, half)
                alive, offs = lists(c.column("alive"))
                at = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
                cand = np.isin(owner_key(values, owner), owner_key(as_long(alive).view(np.uint64), at))
                ok = window_inside(w.counts, w.word_offs, len(h), length)
                full = window_hashes(h, length)[ok][cand] if len(values) else np.zeros(0, np.uint64)
                other = window_hashes(h, length, seed=1)[ok][cand] if len(values) else np.zeros(0, np.uint64)
                owner = owner[cand]
                keep = distinct_per_owner(full, owner)
                yield _emit(_WINDOW, as_long(full[keep]), (other[keep] >> np.uint64(32)).astype(np.uint32).view(np.int32),
                            _ids(c)[owner[keep]])
    return run


def _strip(length: int, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, "text"):
                w = Words(c.column("text"))
                n = len(w)
                values, offs = lists(c.column("repeated"))
                gone = np.zeros(n + 1, dtype=np.int64)
                if len(values) and n >= length:
                    at = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
                    full = window_hashes(w.hashes(), length)
                    ok = window_inside(w.counts, w.word_offs, n, length)
                    hit = np.flatnonzero(ok)[np.isin(owner_key(full[ok], w.doc[:len(full)][ok]),
                                                     owner_key(as_long(values).view(np.uint64), at))]
                    np.add.at(gone, hit, 1)
                    np.add.at(gone, hit + length, -1)
                gone = np.cumsum(gone)[:n] > 0
                copy = c.column("copied").to_numpy(zero_copy_only=False).astype(bool) & (w.counts >= length)
                gone |= np.repeat(copy, w.counts)
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[w.word_offs[1:]] - total[w.word_offs[:-1]]
                kept = []
                for i in range(w.n_docs):
                    if removed[i] == w.counts[i]:
                        kept.append(b"")
                    elif removed[i] == 0:
                        kept.append(b" ".join(w.text(i)))
                    else:
                        kept.append(b" ".join(compress(w.text(i), ~gone[w.word_offs[i]:w.word_offs[i + 1]])))
                yield pa.RecordBatch.from_arrays(
                    [*(c.column(x) for x in carried), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string())], names=[*carried, "n_words", "n_removed", "kept"])
    return run


def _base(docs: DataFrame) -> DataFrame:
    # A plain column where possible: an alias would keep Spark from sharing the text exchange between the joins.
    ident = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(ident, F.coalesce("text", F.lit("")).alias("text"))


def _key():
    return F.unhex(F.md5("text"))


def remove_repeats(docs: DataFrame, min_words: int = 50, carry: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every text without the words covered by a window of `min_words` words that also
    starts in a document with a smaller doc_id. `kept` joins the kept words by one space. With `carry` a struct column `row`
    holds the input row."""
    half = (min_words + 1) // 2
    base = _base(docs)
    if carry:
        base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                           F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = base.where("doc_id is not null")
    texts = named.select("doc_id", "text")

    # Copies of a whole text: all but the smallest doc_id.
    keyed = texts.select("doc_id", _key().alias("key"))
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = (keyed.join(first, "key", "left")
              .groupBy("doc_id").agg(F.collect_set(F.when(F.col("first") < F.col("doc_id"), F.col("key"))).alias("copies"),
                                     F.min(F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))).alias("only_copies"))
              .where(F.size("copies") > 0))

    # Half length: anchors of more than one distinct text (copies alone do not count).
    shared = (texts.select("text", F.xxhash64("text").alias("digest")).mapInArrow(_anchors(min_words, half, "digest"), "h long, digest long")
              .groupBy("h").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("h"))
    anchors = texts.mapInArrow(_anchors(min_words, half, "doc_id"), "h long, doc_id long")
    alive = (anchors.join(shared, "h").groupBy("doc_id").agg(F.collect_list("h").alias("alive"))
             .join(copies.where("only_copies").select("doc_id"), "doc_id", "left_anti"))

    # Full length: extensions of the surviving anchors, and which of them start in an earlier document.
    windows = texts.join(alive, "doc_id").mapInArrow(_windows(min_words, half), "h long, g int, doc_id long")
    earliest = (windows.groupBy("h", "g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                .where("lo < hi").select("h", "g", "lo"))
    repeated = (windows.join(earliest, ["h", "g"]).where("lo < doc_id")
                .groupBy("doc_id").agg(F.collect_list("h").alias("repeated")))

    found = (named.join(repeated, "doc_id", "left").join(copies.select("doc_id", "copies"), "doc_id", "left")
             .withColumn("repeated", F.coalesce("repeated", F.array().cast("array<long>")))
             .withColumn("copied", F.coalesce(F.array_contains("copies", _key()), F.lit(False))).drop("copies"))
    nameless = (base.where("doc_id is null").withColumn("repeated", F.array().cast("array<long>"))
                .withColumn("copied", F.lit(False)))
    carried = ["doc_id", "row"] if carry else ["doc_id"]
    schema = T.StructType([*(base.schema[c] for c in carried), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return found.unionByName(nameless).mapInArrow(_strip(min_words, carried), schema)


_PLACE = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("at", pa.int64())])


def _anchored(length: int, half: int):
    """Where the windows start whose anchor is alive."""
    def find(c: pa.RecordBatch, w: Words, h: np.ndarray) -> np.ndarray:
        values, owner = _anchor_values(w, h, length, half)
        alive, offs = lists(c.column("alive"))
        of = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        ok = np.flatnonzero(window_inside(w.counts, w.word_offs, len(h), length))
        return ok[np.isin(owner_key(values, owner), owner_key(as_long(alive).view(np.uint64), of))] if len(values) else ok[:0]
    return find


def _extended(length: int):
    """Where windows start whose two halves repeat, each on its own."""
    def find(c: pa.RecordBatch, w: Words, h: np.ndarray) -> np.ndarray:
        at, offs = lists(c.column("places"))
        of = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        at = w.word_offs[of] + at
        repeats = np.zeros(len(h), dtype=bool)
        repeats[at] = True
        at = np.sort(at[at + length <= w.word_offs[of + 1]])
        return at[repeats[at + length // 2]]
    return find


def _places(length: int, find):
    """Every window of `length` words at the places that `find` names: 96-bit hash, document, text digest, first word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, "text"):
                w = Words(c.column("text"))
                h = w.hashes()
                at = find(c, w, h)
                if len(at):
                    of = w.doc[at]
                    yield _emit(_PLACE, as_long(window_hashes(h, length)[at]),
                                (window_hashes(h, length, seed=1)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32),
                                _ids(c)[of], _ids(c, "digest")[of], at - w.word_offs[of])
    return run


def repeat_lengths(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, longest_repeat): the largest length min_words * 2**k at which a window of the document also occurs in another
    document; documents without one are absent.

    The first level holds every window of `min_words` words that repeats. A level keeps the windows that occur in more than one
    document and extends those alone: a window of twice the length is a candidate where both of its halves repeat. The levels end when
    no candidate survives; their number is at most log2 of the longest text's words. Each level is written to the shared folder and
    removed once the next one is there. Null and short texts have no window, rows that share a doc_id are one document, exact copies
    under different ids repeat each other whole, a null doc_id takes no part, and an empty table gives an empty result."""
    half, length = (min_words + 1) // 2, min_words
    texts = _base(docs).where("doc_id is not null").withColumn("digest", F.xxhash64("text")).dropDuplicates(["doc_id", "digest"])
    anchors = texts.mapInArrow(_anchors(length, half, "doc_id"), "h long, doc_id long")
    shared = anchors.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h")
    alive = anchors.join(shared, "h").groupBy("doc_id").agg(F.collect_set("h").alias("alive"))
    schema = "h long, g int, doc_id long, digest long, at long"
    level = written(texts.join(alive, "doc_id").mapInArrow(_places(length, _anchored(length, half)), schema), "places")
    found = []
    while True:
        repeated = level.groupBy("h", "g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
        kept = written(level.join(repeated, ["h", "g"], "left_semi"), "repeats")
        drop_scratch(level)
        if kept.isEmpty():
            break
        found.append(written(kept.select("doc_id").distinct().withColumn("length", F.lit(length).cast("long")), "lengths"))
        length *= 2
        places = kept.groupBy("doc_id", "digest").agg(F.collect_list("at").alias("places"))
        level = written(texts.join(places, ["doc_id", "digest"]).mapInArrow(_places(length, _extended(length)), schema), "places")
        drop_scratch(kept)
    if not found:
        return docs.limit(0).select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("longest_repeat"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("doc_id").agg(F.max("length").alias("longest_repeat"))
