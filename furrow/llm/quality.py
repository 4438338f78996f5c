"""Quality rules as a short-circuit cascade.

Every rule is a predicate over whole texts, written in integers so that its verdict does not depend on rounding. Base counts
(words, symbols, repeated lines and word windows) are computed for every document. The cascade then evaluates rules one
after the other on the documents that no earlier rule has rejected. ``plan_cascade`` runs all rules once on a bounded sample
(``SAMPLE_ROWS`` rows), measures each rule's seconds and rejections, and orders rules by rejections per second. The order
changes cost only: a document is kept exactly if no rule rejects it.

Defined edge cases: a null text is an empty one (0 words, fails ``min_words``); extra columns are ignored; equal rows give
equal results; an empty table gives an empty result (and the cascade keeps its written order). Texts are whole, of any length.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.words import Words, chunks, flat, owner_key, window_hashes, window_inside

SAMPLE_ROWS = 500
SAMPLE_BYTES = 1 << 16
MIN_WORDS = 50

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_BANG = np.zeros(256, dtype=bool)
_BANG[ord("!")] = True


def _per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offs[1:]] - total[offs[:-1]]


def repeated_lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines that hold a word, and how many of them equal an earlier line."""
    cuts = np.flatnonzero(w.buf == 10)
    lo = np.sort(np.concatenate([w.offs[:-1], cuts + 1]))
    hi = np.sort(np.concatenate([w.offs[1:], cuts]))
    full = np.searchsorted(w.starts, hi) > np.searchsorted(w.starts, lo)
    lo, hi = lo[full], hi[full]
    doc = np.searchsorted(w.offs, lo, side="right") - 1
    lines = np.bincount(doc, minlength=w.n_docs)
    if not len(lo):
        return lines, lines
    own = np.unique(owner_key(w.byte_hash(lo, hi), doc), return_index=True)[1]
    return lines, lines - np.bincount(doc[own], minlength=w.n_docs)


def repeated_window_words(w: Words, length: int = 3) -> np.ndarray:
    """Per document: words covered by a window of `length` words that occurs twice or more in the document."""
    h, n = w.hashes(), len(w)
    ok = window_inside(w.counts, w.word_offs, n, length)
    if not ok.any():
        return np.zeros(w.n_docs, dtype=np.int64)
    at = np.flatnonzero(ok)
    key = owner_key(window_hashes(h, length)[at], w.doc[at])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(n + length, dtype=bool)
    for k in range(length):
        cover[at[again] + k] = True
    return _per_doc(cover[:n], w.word_offs)


@dataclass
class Stats:
    """Base counts of a chunk of documents, one value per document."""

    words: np.ndarray
    chars: np.ndarray
    symbols: np.ndarray
    lines: np.ndarray
    dup_lines: np.ndarray
    repeat_words: np.ndarray

    def take(self, at: np.ndarray) -> Stats:
        return Stats(*(getattr(self, f)[at] for f in self.__dataclass_fields__))


def base_stats(col: pa.Array) -> Stats:
    w = Words(col)
    inside = np.zeros(len(w.buf) + 1, dtype=np.int8)
    np.add.at(inside, w.starts, 1)
    np.add.at(inside, w.ends, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    lines, dup = repeated_lines(w)
    return Stats(w.counts, _per_doc(inside & ((w.buf & 0xC0) != 0x80), w.offs), _per_doc(_SYMBOL[w.buf], w.offs), lines, dup,
                 repeated_window_words(w))


@dataclass(frozen=True)
class Rule:
    """`rejects(col, stats)` gives one flag per document of an Arrow text column."""

    name: str
    rejects: Callable[[pa.Array, Stats], np.ndarray]


def _bytes_of(kind: np.ndarray, col: pa.Array) -> np.ndarray:
    buf, offs = flat(col)
    return _per_doc(kind[buf], offs)


def _distinct_words(col: pa.Array) -> np.ndarray:
    w = Words(col)
    if not len(w):
        return w.counts
    own = np.unique(owner_key(w.hashes(), w.doc), return_index=True)[1]
    return np.bincount(w.doc[own], minlength=w.n_docs)


RULES = [
    Rule("min_words", lambda c, s: s.words < MIN_WORDS),
    Rule("repeated_windows", lambda c, s: 100 * s.repeat_words > 50 * s.words),
    Rule("symbols", lambda c, s: 5 * s.symbols > s.words),
    Rule("word_length", lambda c, s: (s.chars < 2 * s.words) | (s.chars > 20 * s.words)),
    Rule("repeated_lines", lambda c, s: 10 * s.dup_lines > 6 * s.lines),
    Rule("capitals", lambda c, s: 10 * _bytes_of(_UPPER, c) > 3 * s.chars),
    Rule("exclamations", lambda c, s: 2 * _bytes_of(_BANG, c) > s.words),
    Rule("few_distinct_words", lambda c, s: 10 * _distinct_words(c) < s.words),
]
#: The rules whose verdict is reported apart.
BASE_RULES = ("min_words", "repeated_windows")


def plan_cascade(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per second, measured on at most `rows` documents of at most SAMPLE_BYTES each.

    The sample is taken from the table's first files, so its cost does not grow with the table."""
    names = [r.name for r in rules]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, hits = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0)
        for batch in batches:
            for c in chunks(batch, "text"):
                stats = base_stats(c.column("text"))
                for r in rules:
                    t = time.perf_counter()
                    hits[r.name] += int(r.rejects(c.column("text"), stats).sum())
                    cost[r.name] += time.perf_counter() - t
        yield pa.RecordBatch.from_pydict({"rule": names, "hits": [hits[n] for n in names], "cost": [cost[n] for n in names]})

    sample = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("text").take(rows)
    seen = (docs.sparkSession.createDataFrame(sample, "text string")
            .mapInArrow(measure, "rule string, hits long, cost double")
            .groupBy("rule").agg(F.sum("hits").alias("hits"), F.sum("cost").alias("cost")).collect())
    worth = {r.rule: (r.hits or 0) / max(r.cost or 0.0, 1e-6) for r in seen}
    return sorted(names, key=lambda n: (-worth.get(n, 0.0), names.index(n)))


def _cascade(rules: list[Rule], order: list[str]):
    by = {r.name: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, "text"):
                col = c.column("text")
                stats = base_stats(col)
                verdict = np.full(c.num_rows, "", dtype=object)
                alive = np.arange(c.num_rows)
                for name in order:
                    if not len(alive):
                        break
                    part = col if len(alive) == c.num_rows else col.take(pa.array(alive))
                    bad = by[name].rejects(part, stats.take(alive))
                    verdict[alive[bad]] = name
                    alive = alive[~bad]
                base = (stats.words < MIN_WORDS) | (100 * stats.repeat_words > 50 * stats.words)
                yield pa.RecordBatch.from_arrays([
                    c.column("doc_id"), *(pa.array(x, pa.int64()) for x in (stats.words, stats.chars, stats.symbols,
                                                                           stats.dup_lines, stats.repeat_words)),
                    pa.array(base), pa.array([v or None for v in verdict], pa.string())],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                           "rejected_by"])
    return run


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by).

    `rejected_by` is null for kept documents, else the first rule of the cascade's order that rejects the document; with
    several rejecting rules the name depends on the measured order, whether it is null does not."""
    rules = rules or RULES
    order = plan_cascade(docs, rules)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .mapInArrow(_cascade(rules, order), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                                "n_repeat_words long, base_failed boolean, rejected_by string"))
