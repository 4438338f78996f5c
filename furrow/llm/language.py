"""Language identification of whole texts, word by word.

1. *Script ranges.* The script of a word's first letter (Unicode block ranges) narrows the candidate languages to those whose
   training letters use it (at least ``SCRIPT_SHARE``). A word whose script no language uses, or without a letter, is neutral.
2. *Word scores.* Log-probabilities of the word's byte trigrams (word boundaries included, A-Z lower-cased, hashed into
   ``2**BITS`` buckets) under every language, add-half smoothed. Counts cover every labelled training row.
3. *Viterbi* with a switching penalty labels every word; ties go to the alphabetically first language. A constant path is
   optimal whenever no run of words gains more than the penalty under another language, which one pass of maximum run sums
   decides for all documents of a chunk at once; only mixed texts go through the step-by-step recursion.

The prediction is the language of most letter-bearing words, its score their share. The broadcast model has
``2**BITS + scripts`` numbers per language, whatever the corpus size.

Defined edge cases: a null text or one without a letter is ``und`` with score 0; without any labelled row everything is
``und``; rows with a null doc_id or null lang are never learned from; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.words import _SEP, Words, chunks, mix

BITS = 15
PENALTY = 12.0
SCRIPT_SHARE = 0.01
MAX_LANGUAGES = 1000

# Unicode block ranges of scripts (first code point, last code point, script).
SCRIPT_RANGES = [
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0750, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"), (0x0B80, 0x0BFF, "Tamil"), (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x30FF, "Kana"),
    (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
]
SCRIPTS = ["none", *dict.fromkeys(s for _, _, s in SCRIPT_RANGES), "other"]
_LO = np.array([a for a, _, _ in SCRIPT_RANGES])
_HI = np.array([b for _, b, _ in SCRIPT_RANGES])
_CODE = np.array([SCRIPTS.index(s) for _, _, s in SCRIPT_RANGES])

_T = (mix(np.arange(768, dtype=np.uint64) + np.uint64(7)) & np.uint64(2**BITS - 1)).astype(np.uint16).reshape(3, 256)
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def grams(w: Words) -> np.ndarray:
    """Bucket of the byte trigram centred at every byte; neighbours outside the word count as a space."""
    buf = np.where(_SEP[w.buf], np.uint8(32), w.buf)
    n = len(buf)
    before, after = np.full(n, 32, np.uint8), np.full(n, 32, np.uint8)
    before[1:], after[:-1] = buf[:-1], buf[1:]
    edge = w.offs[(w.offs > 0) & (w.offs < n)]
    before[edge], after[edge - 1] = 32, 32
    return _T[0][before] ^ _T[1][buf] ^ _T[2][after]


def letters(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, script) of every letter."""
    ascii_at = np.flatnonzero(_ASCII_LETTER[w.buf])
    at = np.flatnonzero(w.buf >= 0xC0)
    if not len(at):
        return ascii_at, np.full(len(ascii_at), SCRIPTS.index("Latin"))
    pad = np.concatenate([w.buf, np.zeros(4, np.uint8)]).astype(np.int64)
    lead, c1, c2, c3 = pad[at], pad[at + 1] & 63, pad[at + 2] & 63, pad[at + 3] & 63
    cp = np.where(lead < 0xE0, (lead & 31) << 6 | c1,
                  np.where(lead < 0xF0, (lead & 15) << 12 | c1 << 6 | c2, (lead & 7) << 18 | c1 << 12 | c2 << 6 | c3))
    kinds, back = np.unique(cp, return_inverse=True)
    alpha = np.array([chr(min(int(k), 0x10FFFF)).isalpha() for k in kinds])
    near = np.searchsorted(_LO, kinds, side="right") - 1
    script = np.where((near >= 0) & (kinds <= _HI[near]), _CODE[near], SCRIPTS.index("other"))
    ok = alpha[back]
    pos = np.concatenate([ascii_at, at[ok]])
    code = np.concatenate([np.full(len(ascii_at), SCRIPTS.index("Latin")), script[back][ok]])
    order = np.argsort(pos, kind="stable")
    return pos[order], code[order]


def word_scripts(w: Words) -> np.ndarray:
    """Script of every word's first letter; 0 without one."""
    out = np.zeros(len(w), dtype=np.int64)
    pos, code = letters(w)
    if len(pos) and len(w):
        i = np.searchsorted(pos, w.starts)
        has = i < len(pos)
        has[has] = pos[i[has]] < w.ends[has]
        out[has] = code[i[has]]
    return out


def learn(docs: DataFrame) -> dict:
    """Model of the labelled rows (columns text, lang): {"langs", "gram" float32[2**BITS + 1, L], "script" bool[S, L]}."""
    size = 2**BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for c in chunks(batch, "text"):
                w = Words(c.column("text"), lower=True)
                enc = c.column("lang").dictionary_encode()
                langs, code = enc.dictionary.to_pylist(), enc.indices.to_numpy(zero_copy_only=False)
                owner = np.repeat(code, np.diff(w.offs))
                inside = ~_SEP[w.buf]
                pos, script = letters(w)
                got = np.bincount(owner[inside] * (size + len(SCRIPTS)) + grams(w)[inside],
                                  minlength=len(langs) * (size + len(SCRIPTS)))
                got = got + np.bincount(owner[pos] * (size + len(SCRIPTS)) + size + script, minlength=len(got))
                for i, lang in enumerate(langs):
                    part = got[i * (size + len(SCRIPTS)):(i + 1) * (size + len(SCRIPTS))]
                    total[lang] = total[lang] + part if lang in total else part
        for lang, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(t[at], pa.int64())], names=["lang", "bucket", "n"])

    seen = (docs.where("lang is not null and text is not null").select("text", "lang")
            .mapInArrow(count, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    # At most 2**BITS + len(SCRIPTS) rows per language; the number of languages is checked first.
    langs = [r.lang for r in docs.where("lang is not null").select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = seen.toArrow()
    langs = sorted(langs)
    counts = np.zeros((size + len(SCRIPTS), max(len(langs), 1)))
    if table.num_rows:
        col = np.array([langs.index(x) for x in table.column("lang").unique().to_pylist()])
        enc = table.column("lang").combine_chunks().dictionary_encode()
        counts[table.column("bucket").to_numpy(), col[enc.indices.to_numpy()]] = table.column("n").to_numpy()
    gram, script = counts[:size], counts[size:]
    logp = np.log((gram + 0.5) / (gram.sum(0) + 0.5 * size))
    logp = np.vstack([logp, np.zeros(logp.shape[1])]).astype(np.float32)
    uses = script >= SCRIPT_SHARE * np.maximum(script.sum(0), 1)
    uses[0] = False
    return {"langs": langs, "gram": logp, "script": uses}


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best label sequence of every score matrix (words x languages); all sequences advance together."""
    if not scores:
        return []
    order = np.argsort([-len(s) for s in scores], kind="stable")
    lens = np.array([len(scores[i]) for i in order])
    n_lang = scores[0].shape[1]
    steps, width = int(lens[0]), len(order)
    flat_scores = np.concatenate([scores[i] for i in order])
    start = np.concatenate([[0], np.cumsum(lens)])[:-1]
    back = np.zeros((len(flat_scores), n_lang), dtype=np.int16)
    best = np.zeros((width, n_lang))
    active = np.searchsorted(-lens, -np.arange(steps), side="left")  # sequences with more than t words
    own = np.arange(n_lang)
    for t in range(steps):
        k = active[t]
        row = start[:k] + t
        if t == 0:
            best[:k] = flat_scores[row]
            continue
        prev = best[:k]
        top = prev.argmax(1)
        jump = prev[np.arange(k), top][:, None] - penalty
        stay = prev >= jump
        best[:k] = np.where(stay, prev, jump) + flat_scores[row]
        back[row] = np.where(stay, own[None, :], top[:, None])
    out = [np.zeros(0, np.int64)] * width
    for j, i in enumerate(order):
        n = len(scores[i])
        path = np.zeros(n, dtype=np.int64)
        if n:
            path[-1] = best[j].argmax()
            steps_back = back[start[j]:start[j] + n]
            for t in range(n - 1, 0, -1):
                path[t - 1] = steps_back[t, path[t]]
        out[i] = path
    return out


def label_words(w: Words, model: dict, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(language index, has a letter) of every word of a chunk."""
    n, langs = len(w), model["langs"]
    script = word_scripts(w)
    if not n or not langs:
        return np.full(n, -1), script > 0
    gram = grams(w).astype(np.int64)
    gram[_SEP[w.buf]] = 2**BITS
    score = np.stack([np.add.reduceat(model["gram"][:, j][gram], w.starts, dtype=np.float64) for j in range(len(langs))], axis=1)
    uses = model["script"][script]
    neutral = (script == 0) | ~uses.any(1)
    score = np.where(uses, score, score.min(1, keepdims=True) - 100.0)
    score[neutral] = 0.0
    full = np.flatnonzero(w.counts)
    first = w.word_offs[full]
    total = np.add.reduceat(score, first, axis=0)
    best = np.zeros(w.n_docs, dtype=np.int64)
    best[full] = total.argmax(1)
    label = np.repeat(best, w.counts)
    gain = score - score[np.arange(n), label][:, None]
    # Largest gain of any run of words under another language.
    doc = w.doc
    most = np.zeros(len(full))
    for j in range(len(langs)):
        c = np.cumsum(gain[:, j])
        before = c - gain[:, j]
        base = np.repeat(before[first], w.counts[full])
        wall = (np.abs(c).max() * 2 + 1) * doc
        low = np.minimum.accumulate(before - base - wall) + wall
        most = np.maximum(most, np.maximum.reduceat(c - base - low, first))
    mixed = full[most > penalty]
    for d, path in zip(mixed, viterbi([score[w.word_offs[d]:w.word_offs[d + 1]] for d in mixed], penalty), strict=True):
        label[w.word_offs[d]:w.word_offs[d + 1]] = path
    return label, script > 0


def predict_chunk(col: pa.Array, m: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, number of one-language spans) of every text of a chunk."""
    langs = m["langs"]
    w = Words(col, lower=True)
    label, lettered = label_words(w, m)
    pred, score, spans = ["und"] * w.n_docs, np.zeros(w.n_docs), np.zeros(w.n_docs, np.int64)
    if langs and lettered.any():
        votes = np.bincount(w.doc[lettered] * len(langs) + label[lettered],
                            minlength=w.n_docs * len(langs)).reshape(w.n_docs, len(langs))
        sure = votes.sum(1) > 0
        top = votes.argmax(1)
        score[sure] = votes[np.arange(w.n_docs), top][sure] / votes.sum(1)[sure]
        pred = [langs[t] if s else "und" for t, s in zip(top, sure, strict=True)]
        turn = np.ones(len(label), dtype=bool)
        turn[1:] = (label[1:] != label[:-1]) | (w.doc[1:] != w.doc[:-1])
        spans = np.bincount(w.doc[turn], minlength=w.n_docs)
    return pred, score, spans


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score, n_spans) of every row; n_spans counts the runs of words of one language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, "text"):
                pred, score, spans = predict_chunk(c.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(pred, pa.string()), pa.array(score),
                                                  pa.array(spans, pa.int64())], names=["doc_id", "lang_pred", "score", "n_spans"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double, n_spans long"))


def keep_identified(docs: DataFrame, model: dict, min_score: float) -> DataFrame:
    """The rows whose language is known and holds at least `min_score` of the words, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, "text"):
                pred, score, _ = predict_chunk(c.column("text"), shared.value)
                yield c.filter(pa.array((np.array(pred) != "und") & (score >= min_score)))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id, mod: int, rest: int):
    """crc32(doc_id as text) mod `mod` equals `rest`; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == rest, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32(doc_id as text) mod 3 is not 1, doc_id not null."""
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))


def identify(docs: DataFrame) -> DataFrame:
    """`predict` with a model of the same table's training rows."""
    return predict(docs, learn(training_rows(docs)))
