"""Benchmark decontamination by latent semantic retrieval.

1. *Passages.* Texts are cut into blocks of ``BLOCK`` words; a passage is two neighbouring blocks, so every run of BLOCK words lies
   within one passage. Benchmark items are cut into parts of at most BLOCK words. Words are lower-cased and stripped of ASCII
   punctuation at both ends. The vocabulary is the benchmark's.
2. *TF-IDF and randomised SVD* in two passes over all blocks of the corpus. The first counts document frequencies: stop words
   (in more than ``STOP_SHARE`` of all blocks) have weight zero, but for the LIVE_WORDS rarest words of a part. With term
   weights T and the diagonal IDF matrix D the TF-IDF matrix is A = T D. The second pass computes ``Y = T'T V`` for a test
   matrix V (random mixtures of the benchmark's rows plus Gaussian columns), where ``A'A (D^-1 V) = D Y``. Partitions send
   partial sums of stripes of Y, which are added by stripe. The benchmark's own rows enter with the corpus's total weight, and
   the Nystroem form gives the leading ``RANK`` right singular vectors.
3. *Search.* Every passage is projected and compared with all parts by cosine; candidates reach ``MIN_COSINE``. Beside them stand
   all pairs that share enough of the part's rarer words, or the rarest of its answer, to pass step 4: what the basis does not
   hold (``RANK`` does not grow with the benchmark) is found all the same, and the result equals a full comparison.
4. *Verify.* A bit-parallel longest common subsequence of part and passage (parts have at most 64 words, one machine word per
   candidate) and the same for the part's answer, its last ``ANSWER`` words. A part is found if the subsequence covers
   ``FOUND`` of it, or ``PARAPHRASE`` of it with the whole answer.

The benchmark is a stated query set: parts are compared in groups of ``PARTS``, and what is broadcast grows with the benchmark
alone, whose size is checked against ``MAX_ITEM_BYTES``. Nothing but word frequencies and stripes of Y (benchmark vocabulary
times RANK) is gathered from the corpus.

Defined edge cases: null or word-free texts and items match nothing; a null doc_id can match, its id stays null; repeated rows
are reported row by row; an item of one word is found where the word is; extra columns are ignored; an empty corpus or
benchmark gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.words import Words, chunks, unused

BLOCK = 64
STOP_SHARE = 0.02
LIVE_WORDS = 8
RANK = 96
EXTRA = 16
MIN_COSINE = 0.3
FOUND = 0.75
PARAPHRASE = 0.5
ANSWER = 8
#: Rarest words of an answer that a passage must hold; postings handled at a time.
ANSWER_WORDS = 4
MAX_POSTINGS = 1 << 21
PARTS = 256
MAX_ITEM_BYTES = 32 << 20
STRIPE = 256

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[list(b"!\"'(),-.:;?[]{}")] = True


def word_hashes(w: Words) -> np.ndarray:
    """Hashes of the words without punctuation at their ends (a word of punctuation alone stays)."""
    lo, hi = w.starts.copy(), w.ends.copy()
    at = np.flatnonzero(_PUNCT[w.buf[lo]])
    while len(at := at[(lo[at] < hi[at] - 1) & _PUNCT[w.buf[lo[at]]]]):
        lo[at] += 1
    at = np.flatnonzero(_PUNCT[w.buf[hi - 1]])
    while len(at := at[(hi[at] - 1 > lo[at]) & _PUNCT[w.buf[hi[at] - 1]]]):
        hi[at] -= 1
    return w.byte_hash(lo, hi)


@dataclass
class Benchmark:
    vocabulary: np.ndarray        # sorted word hashes
    parts: list[np.ndarray]       # vocabulary indices of every part's words
    items: np.ndarray             # item_id of every part
    idf: np.ndarray | None = None  # zero for stop words
    basis: np.ndarray | None = None
    df: np.ndarray | None = None   # blocks of the corpus that hold the word

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary index of every hash, -1 outside."""
        if not hasattr(self, "_maybe"):
            self._maybe = np.zeros(1 << 20, dtype=bool)
            self._maybe[self.vocabulary >> np.uint64(44)] = True
        out = np.full(len(hashes), -1, dtype=np.int64)
        at = np.flatnonzero(self._maybe[hashes >> np.uint64(44)])
        i = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        ok = self.vocabulary[i] == hashes[at]
        out[at[ok]] = i[ok]
        return out


def read_benchmark(items: DataFrame) -> Benchmark:
    """The benchmark's parts and vocabulary; at most MAX_ITEM_BYTES of text."""
    items = (items.where("item_id is not null and text is not null")
             .select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_ITEM_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text; pass it in parts of at most {MAX_ITEM_BYTES}")
    rows = items.orderBy("item_id", "text").toArrow()
    col = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
    w = Words(col)
    h = word_hashes(w)
    vocabulary = np.unique(h)
    words = np.searchsorted(vocabulary, h)
    parts, owner = [], []
    for item, lo, hi in zip(rows.column("item_id").to_pylist(), w.word_offs[:-1], w.word_offs[1:], strict=True):
        for a in range(lo, hi, BLOCK):
            part = words[a:min(a + BLOCK, hi)]
            if a > lo and len(part) < ANSWER:
                part = words[hi - ANSWER:hi]
            parts.append(part)
            owner.append(item)
    return Benchmark(vocabulary, parts, np.array(owner, dtype=np.int64))


def _blocks(b: Benchmark, col: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, vocabulary index per word, block of every word, first block of every document)."""
    w = Words(col)
    ids = b.find(word_hashes(w))
    per = -(-w.counts // BLOCK)
    first = np.concatenate([[0], np.cumsum(per)])
    block = np.repeat(first[:-1], w.counts) + (np.arange(len(w)) - np.repeat(w.word_offs[:-1], w.counts)) // BLOCK
    return w, ids, block, first


def _weights(b: Benchmark, ids: np.ndarray, block: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, word, weight) of the distinct weighted words of every block, in block order; `plain` leaves the IDF out."""
    at = np.flatnonzero(ids >= 0)
    if b.idf is not None:
        at = at[b.idf[ids[at]] > 0]
    key, n = np.unique(block[at] * len(b.vocabulary) + ids[at], return_counts=True)
    word = key % len(b.vocabulary)
    return key // len(b.vocabulary), word, (1 + np.log(n)) * (1.0 if plain or b.idf is None else b.idf[word])


def _frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Benchmark = shared.value
        df = np.zeros(len(b.vocabulary) + 1, dtype=np.int64)  # the last entry counts blocks
        for batch in batches:
            for c in chunks(batch, "text"):
                _, ids, block, first = _blocks(b, c.column("text"))
                at = np.flatnonzero(ids >= 0)
                key = np.sort(block[at] * len(b.vocabulary) + ids[at])
                key = key[np.diff(key, prepend=-1) != 0]
                df += np.bincount(key % len(b.vocabulary), minlength=len(df))
                df[-1] += first[-1]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["word", "n"])
    return run


def _products(shared, test):
    """Stripes of T'T V over a partition's blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Benchmark = shared.value
        v = test.value
        y, met = np.zeros_like(v), np.zeros(len(v), dtype=bool)
        for batch in batches:
            for c in chunks(batch, "text"):
                _, ids, block, _ = _blocks(b, c.column("text"))
                own, word, x = _weights(b, ids, block, plain=True)
                met[word] = True
                if not len(own):
                    continue
                x = x[:, None].astype(np.float32)
                head = np.flatnonzero(np.diff(own, prepend=-1))
                z = np.add.reduceat(v[word] * x, head, axis=0)
                order = np.argsort(word, kind="stable")
                start = np.flatnonzero(np.diff(word[order], prepend=-1))
                row = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(own))))
                y[word[order][start]] += np.add.reduceat(z[row[order]] * x[order], start, axis=0)
        for lo in range(0, len(v), STRIPE):
            if met[lo:lo + STRIPE].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lo], pa.int32()), pa.array([y[lo:lo + STRIPE].tobytes()], pa.binary())], names=["stripe", "y"])
    return run


_STRIPE = "stripe int, y binary"


def _add(group: pd.DataFrame) -> pd.DataFrame:
    y = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in group["y"])
    return pd.DataFrame({"stripe": [group["stripe"].iloc[0]], "y": [y.astype(np.float32).tobytes()]})


def fit(docs: DataFrame, b: Benchmark, rank: int = RANK, seed: int = 11) -> Benchmark:
    """The benchmark with IDF weights and latent basis from all blocks of the corpus."""
    sc = docs.sparkSession.sparkContext
    texts = docs.where("text is not null").select(F.lower("text").alias("text"))
    n_words = len(b.vocabulary)
    seen = np.zeros(n_words + 1)
    for r in (texts.mapInArrow(_frequencies(sc.broadcast(b)), "word int, n long")
              .groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator()):
        seen[r.word] = r.n
    df, blocks = seen[:-1], seen[-1]
    live = df <= STOP_SHARE * max(blocks, 1.0)
    for part in b.parts:
        word = np.unique(part)
        live[word[np.argsort(df[word], kind="stable")[:LIVE_WORDS]]] = True
    b = Benchmark(b.vocabulary, b.parts, b.items, live.astype(float))

    rng = np.random.default_rng(seed)
    rows = np.zeros((len(b.parts), n_words), dtype=np.float32)  # the benchmark's own term weights
    for i, part in enumerate(b.parts):
        word, n = np.unique(part, return_counts=True)
        rows[i, word] = (1 + np.log(n)) * live[word]
    columns = min(rank + EXTRA, n_words)
    mixed = rows.T @ rng.standard_normal((len(b.parts), columns - columns // 5))
    test, _ = np.linalg.qr(np.hstack([mixed, rng.standard_normal((n_words, columns // 5)) * live[:, None]]))
    test = np.ascontiguousarray(test * live[:, None], dtype=np.float32)
    y = np.zeros(test.shape)
    for r in (texts.mapInArrow(_products(sc.broadcast(b), sc.broadcast(test)), _STRIPE)
              .groupBy("stripe").applyInPandas(_add, _STRIPE).toLocalIterator()):
        part = np.frombuffer(r.y, np.float32).reshape(-1, test.shape[1])
        y[r.stripe:r.stripe + len(part)] += part
    idf = np.where(live, np.log((max(blocks, 1) + 1) / (df + 0.5)), 0.0)
    idf[live] = np.maximum(idf[live], 0.1)

    own = rows * idf[None, :]
    inverse = np.where(live, 1 / np.maximum(idf, 0.1), 0.0)
    y = idf[:, None] * y
    extra = own.T @ (own @ (inverse[:, None] * test))
    y += extra * max(1.0, float((idf**2 * df).sum())) / max(float((own**2).sum()), 1e-12)
    core = (test * inverse[:, None]).T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > max(value.max(), 1e-300) * 1e-10
    basis, _, _ = np.linalg.svd(y @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    b.idf, b.df = idf, df
    b.basis = np.ascontiguousarray(basis[:, :rank], dtype=np.float32)
    return b


def lcs(masks: np.ndarray) -> np.ndarray:
    """Longest common subsequence lengths; masks[t, c] has a bit for every part position equal to passage word t of candidate c."""
    one = np.uint64(0xFFFFFFFFFFFFFFFF)
    v = np.full(masks.shape[1], one)
    for m in masks:
        u = v & m
        v = (v + u) | (v & ~m)
    return np.bitwise_count(~v).astype(np.int64)


class _Searcher:
    """Per-worker tables of the part groups."""

    def __init__(self, b: Benchmark):
        self.b = b
        self.lengths = np.array([len(p) for p in b.parts])
        weight = np.zeros((len(b.parts), b.basis.shape[1]), dtype=np.float32)
        for i, part in enumerate(b.parts):
            word, n = np.unique(part, return_counts=True)
            weight[i] = ((1 + np.log(n)) * b.idf[word]).astype(np.float32) @ b.basis[word]
        norm = np.linalg.norm(weight, axis=1, keepdims=True)
        self.latent = weight / np.maximum(norm, 1e-6)
        self._post()
        self.groups = []
        for lo in range(0, len(b.parts), PARTS):
            hi = min(lo + PARTS, len(b.parts))
            words = np.unique(np.concatenate(b.parts[lo:hi]))
            mask = np.zeros((hi - lo, len(words) + 1), dtype=np.uint64)
            for i in range(lo, hi):
                np.bitwise_or.at(mask[i - lo], np.searchsorted(words, b.parts[i]),
                                 np.uint64(1) << np.arange(len(b.parts[i]), dtype=np.uint64))
            local = np.full(len(b.vocabulary) + 1, len(words))
            local[words] = np.arange(len(words))
            self.groups.append((lo, hi, local, mask))

    def _post(self) -> None:
        """Postings (word -> target, positions) of what a passage must share with a part to be a hit, rarest words first.

        Target i: a subsequence of FOUND of part i misses few positions, so most of its rarer half must be there. Target
        len(parts) + i: the whole answer must be there, so its rarest words."""
        b, n = self.b, len(self.b.parts)
        words, targets, counts, self.need = [], [], [], np.zeros(2 * n, dtype=np.int64)
        for i, part in enumerate(b.parts):
            miss = len(part) - int(np.ceil(FOUND * len(part)))
            rare = part[np.argsort(b.df[part], kind="stable")[:max(miss + 1, (len(part) + 1) // 2)]]
            answer = np.unique(part[-ANSWER:])
            answer = answer[np.argsort(b.df[answer], kind="stable")[:ANSWER_WORDS]]
            for target, x, need in ((i, rare, len(rare) - miss), (n + i, answer, len(answer))):
                word, k = np.unique(x, return_counts=True)
                words.append(word)
                targets.append(np.full(len(word), target))
                counts.append(k)
                self.need[target] = need
        word = np.concatenate(words)
        order = np.argsort(word, kind="stable")
        self.target, self.positions = np.concatenate(targets)[order], np.concatenate(counts)[order]
        self.posted = np.bincount(word, minlength=len(b.vocabulary))
        self.post = np.cumsum(self.posted) - self.posted

    def sharing(self, ids: np.ndarray, block: np.ndarray, doc: np.ndarray, only: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first block, part) of every passage and part that share enough words to be a hit: none that could be one is left out."""
        size, n = len(self.b.vocabulary), len(self.b.parts)
        at = np.flatnonzero(ids >= 0)
        at = at[self.posted[ids[at]] > 0]
        key = np.sort(block[at] * size + ids[at])
        key = key[np.diff(key, prepend=-1) != 0]
        own = key // size
        before = key[(own > 0) & (doc[own - 1] == doc[own])] - size  # the passage that starts one block earlier
        key = np.sort(np.concatenate([key[only[own]], before]))
        key = key[np.diff(key, prepend=-1) != 0]
        own, word = key // size, key % size
        total = np.cumsum(self.posted[word])
        blocks, parts, lo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while lo < len(key):  # whole passages, a bounded number of postings at a time
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + MAX_POSTINGS, side="right"))
            hi = int(np.searchsorted(own, own[hi])) if hi < len(key) else hi
            hi = hi if hi > lo else int(np.searchsorted(own, own[lo], side="right"))
            k = self.posted[word[lo:hi]]
            i = np.repeat(self.post[word[lo:hi]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            x = np.sort(((np.repeat(own[lo:hi], k) * (2 * n) + self.target[i]) << 7) | self.positions[i])
            head = np.flatnonzero(np.diff(x >> 7, prepend=-1))
            pair = x[head] >> 7
            pair = pair[np.add.reduceat(x & 127, head) >= self.need[pair % (2 * n)]]
            blocks.append(pair // (2 * n))
            parts.append(pair % (2 * n) % n)
            lo = hi
        return np.concatenate(blocks), np.concatenate(parts)

    def candidates(self, col: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """(words, vocabulary index per word, passage start word, part) of every candidate pair."""
        b = self.b
        w, ids, block, first = _blocks(b, col)
        n_blocks = int(first[-1])
        own, word, x = _weights(b, ids, block)
        spot = np.zeros((n_blocks, b.basis.shape[1]), dtype=np.float32)
        head = np.flatnonzero(np.diff(own, prepend=-1))
        if len(own):
            spot[own[head]] = np.add.reduceat(b.basis[word] * x[:, None].astype(np.float32), head, axis=0)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        pair = spot.copy()
        if n_blocks > 1:
            joined = doc[1:] == doc[:-1]
            pair[:-1][joined] += spot[1:][joined]
            only = np.append(joined, False) | (np.diff(first)[doc] == 1)  # a last block is in the passage before
        else:
            only = np.ones(n_blocks, dtype=bool)
        norm = np.linalg.norm(pair, axis=1)
        at = np.flatnonzero(only & (norm > 0))
        blocks, parts = self.sharing(ids, block, doc, only)
        keys = [blocks * len(b.parts) + parts]
        for lo in range(0, len(at), 8192):
            block_ids = at[lo:lo + 8192]
            near = pair[block_ids] @ self.latent.T >= MIN_COSINE * norm[block_ids][:, None]
            p, i = np.nonzero(near)
            keys.append(block_ids[p] * len(b.parts) + i)
        key = np.unique(np.concatenate(keys))
        at, part = key // len(b.parts), key % len(b.parts)
        return w, ids, w.word_offs[doc[at]] + (at - first[doc[at]]) * BLOCK, part

    def verify(self, w: Words, ids: np.ndarray, start: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(common subsequence length, whole answer present) of every candidate."""
        common, answer = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=bool)
        end = np.repeat(w.word_offs[1:], w.counts)
        padded = np.append(ids, -1)
        for lo, hi, local, mask in self.groups:
            group = np.flatnonzero((part >= lo) & (part < hi))
            for a in range(0, len(group), 20_000):
                c = group[a:a + 20_000]
                at = start[c][None, :] + np.arange(2 * BLOCK)[:, None]
                at = np.where(at < end[start[c]][None, :], at, len(ids))
                word = local[padded[at]]  # -1 reads the last entry, which is no word of the group
                m = mask[(part[c] - lo)[None, :], word]
                common[c] = lcs(m)
                size = self.lengths[part[c]]
                keep = common[c] >= PARAPHRASE * size
                if keep.any():
                    d = c[keep]
                    tail = np.minimum(ANSWER, self.lengths[part[d]])
                    shift = (self.lengths[part[d]] - tail).astype(np.uint64)
                    ones = (np.uint64(1) << tail.astype(np.uint64)) - np.uint64(1)
                    answer[d] = lcs(m[:, keep] & (ones << shift)[None, :]) == tail
        return common, answer


    def find(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best passage of every (document, item) found: document index, item_id, share of the part, answer, start word."""
        w, ids, start, part = self.candidates(col)
        common, answer = self.verify(w, ids, start, part)
        share = common / self.lengths[part] if len(part) else np.zeros(0)
        hit = np.flatnonzero((share >= FOUND) | ((share >= PARAPHRASE) & answer))
        doc = np.searchsorted(w.word_offs, start[hit], side="right") - 1
        item = self.b.items[part[hit]]
        order = np.lexsort((start[hit], -share[hit], item, doc))
        doc, item, hit = doc[order], item[order], hit[order]
        new = np.ones(len(hit), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        doc, item, hit = doc[new], item[new], hit[new]
        return doc, item, share[hit], answer[hit], start[hit] - w.word_offs[doc]


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _Searcher(shared.value)
        for batch in batches:
            for c in chunks(batch, "__text"):
                doc, item, share, answer, start = s.find(c.column("__text"))
                yield pa.RecordBatch.from_arrays(
                    [c.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(item, pa.int64()), pa.array(share, pa.float64()),
                     pa.array(answer, pa.bool_()), pa.array(start, pa.int64())],
                    names=["doc_id", "item_id", "lcs_share", "answer_found", "passage_start"])
    return run


def _clean(shared, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _Searcher(shared.value)
        for batch in batches:
            for c in chunks(batch, column):
                keep = np.ones(c.num_rows, dtype=bool)
                keep[s.find(c.column(column))[0]] = False
                yield c.drop_columns([column]).filter(pa.array(keep))
    return run


_LEAK = "doc_id long, item_id long, lcs_share double, answer_found boolean, passage_start long"


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, lcs_share, answer_found, passage_start): the best passage of every document row and item found in it."""
    b = read_benchmark(items)
    if not b.parts:
        return docs.sparkSession.createDataFrame([], _LEAK)
    b = fit(docs, b)
    return (docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("__text"))
            .mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(b)), _LEAK))


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows in which no benchmark item is found, with all their columns."""
    b = read_benchmark(items)
    if not b.parts:
        return docs
    b = fit(docs, b)
    column = unused("__text", docs.columns)
    return (docs.withColumn(column, F.coalesce(F.lower("text"), F.lit("")))
            .mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(b), column), docs.schema))
