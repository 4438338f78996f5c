"""Spelling variant grouping over permuterm rotations.

A word of L code points, ended by a terminator, has L + 1 rotations. A rotation that ends in the word's code point i, less that
last one, is the prefix that the word shares with

* every word of the same length that differs in code point i alone (its rotation has the same prefix and another last code point),
* the one word that lacks code point i (this prefix is a whole rotation of that word).

So each word gives L *hole* entries (prefixes that skip one code point) and L + 1 *whole* entries (full rotations), and words at
one insertion, deletion or replacement meet in a group of equal prefixes. One shuffle sorts the rotations by prefix; a scan of each
group reads the number of its holes, its two most frequent holes and its whole word, and hands every member its neighbour count and
its best neighbours. Pairs are never listed: a group has at most one hole per letter of the alphabet, and each member gets at most
two candidates. A replacement meets in exactly one group. Deleting any letter of a run of equal letters gives the same word, so
only the first one of a run counts for insertions and deletions.

A rotation of over ``LONGEST`` code points is represented by two 64-bit polynomial hashes (O(1) each from prefix sums), so a word of
any length costs memory in proportion to its length; its identity in the groups is its beginning and its rank among the long words
with that beginning, which keeps code-point order.

A word's *form* is its near word with the largest count (ties: the smallest in code-point order), if that count is at least
``ratio`` times its own; forms are followed to their *root* by pointer doubling. Counts grow by the ratio at every step, so
chains are short and free of cycles.

Defined edge cases: null texts have no words; a null doc_id is a document like any other; repeated rows count again; extra columns
are ignored; an empty table gives an empty result; words of ``group`` are distinct and hold no U+0000, null words are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.words import mix, window_hashes
from furrow.session import drop_scratch, written

#: Fixed value: the letters of a run.
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Code points of a word whose rotations are spelt out; longer rotations are hashed.
LONGEST = 64
END = "\x00"
_ENTRY = "key string, id string, n long, letter string, whole boolean, first boolean"
_LONG_ROWS = 4096


def runs(docs: DataFrame, min_length: int) -> DataFrame:
    """(doc_id, run): maximal runs of at least min_length letters, A-Z lower-cased. (Letters match greedily, so a match of the
    bounded pattern is a whole run.)"""
    found = F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{int(min_length)},}}"), F.lit(0))
    low = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", low.alias("run"))


def count_words(rows: DataFrame, word: Column, min_length: int, min_count: int) -> DataFrame:
    """(word, n): words of enough code points and occurrences, counted with a partial aggregate."""
    return (rows.select(word.alias("word")).where(F.length("word") >= min_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def _short_entries(words: DataFrame) -> DataFrame:
    """Entries of words of at most LONGEST code points, spelt out; one row a rotation, never an array of all."""
    turn = words.select("id", "n", F.length("id").alias("size"), F.explode(F.sequence(F.lit(0), F.length("id"))).alias("i"))
    tail = F.expr("substring(id, i + 1)")
    whole = F.struct(F.concat(tail, F.lit(END), F.expr("substring(id, 1, i)")).alias("key"), F.lit(None).cast("string").alias("letter"),
                     F.lit(True).alias("whole"), F.lit(False).alias("first"))
    letter = F.expr("substring(id, i + 1, 1)")
    hole = F.struct(F.concat(F.expr("substring(id, i + 2)"), F.lit(END), F.expr("substring(id, 1, i)")).alias("key"),
                    letter.alias("letter"), F.lit(False).alias("whole"),
                    ((F.col("i") == 0) | (letter != F.expr("substring(id, greatest(i, 1), 1)"))).alias("first"))
    both = F.when(F.col("i") < F.col("size"), F.array(whole, hole)).otherwise(F.array(whole))
    return turn.select("id", "n", F.inline(both)).select("key", "id", "n", "letter", "whole", "first")


def _long_keys(code: np.ndarray, text: str, size: int) -> list[str]:
    """Keys of the rotations of `size` symbols that start at each symbol of a word (text ends with END, twice in a row)."""
    n = len(code) // 2
    if size <= LONGEST + 1:
        return [text[j:j + size] for j in range(n)]
    a, b = (window_hashes(code, size, seed)[:n] for seed in (0, 1))
    return [f"#{size}:{x:016x}{y:016x}" for x, y in zip(a.tolist(), b.tolist())]


def _long_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
    names = ["key", "id", "n", "letter", "whole", "first"]
    for batch in batches:
        for word, ident, n in zip(*(batch.column(c).to_pylist() for c in ("word", "id", "n"))):
            size = len(word)
            text = (word + END) * 2
            points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            code = mix(points.astype(np.uint64) + np.uint64(1))
            rows = [(k, ident, n, None, True, False) for k in _long_keys(code, text, size + 1)]
            holes = _long_keys(code, text, size)  # the hole of letter i starts at the symbol after it
            rows += [(holes[i + 1], ident, n, word[i], False, i == 0 or word[i] != word[i - 1]) for i in range(size)]
            for lo in range(0, len(rows), _LONG_ROWS):
                part = list(zip(*rows[lo:lo + _LONG_ROWS]))
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(part, kind)], names)


def _scan(entries: DataFrame) -> DataFrame:
    """(id, near, other, other_n): what every member of a group learns; at most two rows a member."""
    best = Window.partitionBy("key").orderBy(F.desc("n"), "letter").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    who = F.struct("id", "n")
    hole, opening = F.when(~F.col("whole"), who), F.when(~F.col("whole") & F.col("first"), who)
    g = entries.select(
        "id", "whole", "first", F.count(hole).over(best).alias("holes"), F.count(opening).over(best).alias("openings"),
        F.first(hole, ignorenulls=True).over(best).alias("one"), F.nth_value(hole, 2, ignoreNulls=True).over(best).alias("two"),
        F.first(opening, ignorenulls=True).over(best).alias("open_one"), F.first(F.when(F.col("whole"), who), ignorenulls=True).over(best).alias("full"))
    other = F.when(F.col("one.id") == F.col("id"), F.col("two")).otherwise(F.col("one"))
    full = F.when(F.col("first"), F.col("full"))
    near = F.when(F.col("whole"), F.col("openings")).otherwise(F.col("holes") - 1 + F.when(full.isNotNull(), 1).otherwise(0))
    seen = F.when(F.col("whole"), F.array("open_one")).otherwise(F.array(other, full))
    g = g.select("id", near.alias("near"), seen.alias("seen")).where("near > 0")
    g = g.select("id", "near", F.posexplode(F.filter("seen", lambda s: s.isNotNull())).alias("p", "other"))
    return g.select("id", F.when(F.col("p") == 0, F.col("near")).otherwise(0).alias("near"), F.col("other.id").alias("other"),
                    F.col("other.n").alias("other_n"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n): words with at least one near word, how many, and the most frequent of them."""
    words = words.where("word is not null").select("word", F.col("n").cast("long").alias("n"))
    size = F.length("word")
    entries = _short_entries(words.where(size <= LONGEST).select(F.col("word").alias("id"), "n"))
    start = F.expr(f"substring(word, 1, {LONGEST})")
    rank = F.row_number().over(Window.partitionBy(start).orderBy("word"))
    long = words.where(size > LONGEST).withColumn("id", F.concat(start, F.lit(END), F.lpad(rank.cast("string"), 19, "0")))
    some_long = not words.where(size > LONGEST).isEmpty()
    if some_long:
        entries = entries.unionByName(long.mapInArrow(_long_entries, _ENTRY))
    near = (_scan(entries).groupBy("id")
            .agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("b"))
            .select("id", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n")))
    if some_long:
        for column in ("id", "best"):
            named = long.select(F.col("id").alias(column), "word")
            near = (near.where(~F.contains(column, F.lit(END)))
                    .unionByName(near.join(named, column).withColumn(column, F.col("word")).drop("word")))
    return near.withColumnRenamed("id", "word")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a (word, form) table without cycles, by pointer doubling: rounds grow with the log of the longest chain."""
    spark = forms.sparkSession
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(step, "root", "left_semi").isEmpty():
            return now
        before, now = now, written(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        drop_scratch(before)


def group(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of a (word, n) table; the words should be a stored table."""
    near = near_words(words)
    takes = F.col("best_n") >= ratio * F.col("n")
    full = written(words.where("word is not null").join(near, "word", "left").select(
        "word", F.when(takes, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best_n")).alias("form_n")), "variants")
    out = full.join(roots(full.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
