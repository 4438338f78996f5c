"""Language-model scoring with a log-frequency Bloom filter.

Training counts every token and every pair of neighbouring tokens of the training rows, without a cutoff. A count n is quantised
to its level 1 + floor(log2 n), and the filter holds the keys (n-gram, 1) ... (n-gram, level), so a lookup probes upwards until
a miss and never underestimates.

The filter is made of ``BLOCKS`` blocks that own a range of hashes each. Counts travel to the task that owns their block, which
adds them up, sizes the block by its own keys (``KEY_BITS`` bits or more a key) and stores it with the exact counts of the block's
single tokens. The filter therefore grows with the n-grams of the corpus and is never gathered or broadcast.

Scoring sends the distinct n-grams of every chunk of texts to the blocks that own them (one exchange), where a block's filter is
held while its requests stream by; the answers return to the chunk (a second exchange), which scores its rows. This is the way
at every size. Single tokens of at least N / HOT occurrences (at most HOT of them, by counting) are not asked for: their exact
counts come from a broadcast table.

Scores mix the pair estimate with the single-token one: P(w | v) = L q(v, w) / c(v) + (1 - L) (c(w) + 1) / (N + V + 1). Single tokens have
exact counts; a pair's q is the smallest count of its level, so that a context's pairs add up to at most one (but for the filter's
false positives) and the mixture is a probability, with what quantising takes off left unused. L depends on the level of c(v) and is
fitted by deleted interpolation: every training row is scored with each of its own tokens taken out of the counts, and each level takes
the weight of the best likelihood (levels seen little lean on all tokens).

Tokens are 64-bit hashes of A-Z lower-cased words, plus one end token per text. Defined edge cases: a null text is empty (one
end token); a null doc_id is scored, not learned from; without training rows N = V = 0 and every score is 0 or the log of the
mixture with zero counts; repeated rows are scored one by one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.words import Words, as_long, chunks, flat, mix
from furrow.session import scratch_path

BLOCKS = 1 << 10
PROBES = 5
#: Bits a key, before rounding up to a power of two per block: the false-positive rate of one level stays under 3 %.
KEY_BITS = 8
#: N-grams that a counting task adds up before it sends them on.
COMBINE = 1 << 20
#: Text of a chunk that is scored together.
CHUNK_BYTES = 1 << 22
HOT = 1 << 20
#: One in this many training rows fits the weights of the mixture: every row.
FIT_SHARE = 1
#: Weights that are tried, and the tokens of all levels that each level's choice is smoothed with.
WEIGHTS = np.arange(1, 50) / 50
LEAN = 100.0
LEVELS = 64

_END = np.uint64(0x5851F42D4C957F2C)
_START = np.uint64(0x14057B7EF767814E)
_ONE = np.uint64(1)


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with an end token per document, hashes of (previous, token) pairs, document offsets).

    Token hashes are even, pair hashes odd."""
    ends = w.word_offs[1:] + np.arange(w.n_docs)
    offs = w.word_offs + np.arange(w.n_docs + 1)
    tok = np.empty(len(w) + w.n_docs, dtype=np.uint64)
    is_word = np.ones(len(tok), dtype=bool)
    is_word[ends] = False
    tok[is_word] = w.hashes()
    tok[ends] = _END
    tok &= ~_ONE
    return tok, _pairs(tok, offs), offs


def _pairs(tok: np.ndarray, offs: np.ndarray) -> np.ndarray:
    prev = np.empty_like(tok)
    prev[1:] = tok[:-1]
    prev[offs[:-1]] = _START
    return mix(prev * np.uint64(0x9FB21C651E98DF25) + tok) | _ONE


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The value runs between the cuts, as one binary value each."""
    at = (cuts * (values.itemsize * math.prod(values.shape[1:]))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def block_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BLOCKS.bit_length() + 1)).astype(np.int64)


def _packed(h: np.ndarray) -> np.ndarray:
    """The low seven bytes of every hash; the block's number has the rest (BLOCKS is at least 256)."""
    return h.view(np.uint8).reshape(-1, 8)[:, :7]


def _unpacked(raw: np.ndarray, block: np.ndarray) -> np.ndarray:
    full = np.zeros((len(raw) // 7, 8), dtype=np.uint8)
    full[:, :7] = raw.reshape(-1, 7)
    return full.view(np.uint64).ravel() | (block.astype(np.uint64) << np.uint64(64 - BLOCKS.bit_length() + 1))


def _added(h: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, with the sums of their counts."""
    h, n = np.concatenate(h), np.concatenate(n).astype(np.int64)
    order = np.argsort(h)
    h, n = h[order], n[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    return h[first], np.add.reduceat(n, first) if len(first) else n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hs, ns, size = [], [], 0

    def send():
        h, n = _added(hs, ns)
        own, first = np.unique(block_of(h), return_index=True)
        cuts = np.append(first, len(h))
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), _blobs(_packed(h), cuts), _blobs(n, cuts)], names=["block", "h", "n"])

    for batch in batches:
        for c in chunks(batch, "text"):
            tok, pair, _ = tokens(Words(c.column("text"), lower=True))
            h, n = np.unique(np.concatenate([tok, pair]), return_counts=True)
            hs.append(h)
            ns.append(n)
            size += len(h)
            if size >= COMBINE:
                yield send()
                hs, ns, size = [], [], 0
    if size:
        yield send()


def _level(n: np.ndarray) -> np.ndarray:
    """1 + floor(log2 n), 0 for 0."""
    return np.where(n > 0, np.frexp(n.astype(np.float64))[1], 0)


def _least(level: np.ndarray) -> np.ndarray:
    """Smallest count of a level, 0 if absent."""
    return np.where(level > 0, 2.0 ** (level - 1.0), 0.0)


def _bits_of(h: np.ndarray, level: np.ndarray, n_bits: int) -> np.ndarray:
    """PROBES bit positions (within the n-gram's block) per key."""
    x = mix(h ^ (level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    step = (x >> np.uint64(32)) | _ONE
    return (x[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(n_bits - 1)


def _filled(h: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The packed bits of a block with the given n-grams."""
    n_bits = 1 << max(6, int(KEY_BITS * level.sum() - 1).bit_length())
    bits = np.zeros(n_bits, dtype=bool)
    for lv in range(1, int(level.max(initial=0)) + 1):
        key = h[level >= lv]
        for lo in range(0, len(key), 1 << 18):
            part = key[lo:lo + (1 << 18)]
            bits[_bits_of(part, np.full(len(part), lv), n_bits).ravel()] = True
    return np.packbits(bits)


def probe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Quantised level of every n-gram hash in its block's packed bits, 0 if absent."""
    level = np.zeros(len(h), dtype=np.int64)
    at = np.arange(len(h)) if len(bits) else np.zeros(0, np.int64)
    while len(at):
        pos = _bits_of(h[at], level[at] + 1, 8 * len(bits)).astype(np.int64)
        hit = np.ones(len(at), dtype=bool)
        for k in range(PROBES):
            i = np.flatnonzero(hit)
            p = pos[i, k]
            hit[i] = (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
        at = at[hit]
        level[at] += 1
    return level


#: words: hashes of the block's single tokens, then their counts.
_BLOCK = "block int, bits binary, words binary, n_tokens long, n_distinct long"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
    size: dict[int, list[int]] = {}  # n-grams held, and how many may be before they are added up
    for batch in batches:
        h, offs = flat(batch.column("h"))
        n, offs = flat(batch.column("n"))[0].copy().view(np.int64), offs // 7
        h = _unpacked(h, np.repeat(batch.column("block").to_numpy(), np.diff(offs)))
        for b, lo, hi in zip(batch.column("block").to_pylist(), offs[:-1], offs[1:], strict=True):
            hs, ns = held.setdefault(b, ([], []))
            hs.append(h[lo:hi].copy())
            ns.append(n[lo:hi].astype(np.uint32 if n[lo:hi].max() < 1 << 32 else np.int64))
            now = size.setdefault(b, [0, 1 << 16])
            now[0] += int(hi - lo)
            if now[0] > now[1]:
                x, k = _added(hs, ns)
                held[b] = ([x], [k])
                size[b] = [len(x), max(1 << 16, 2 * len(x))]
    for b in sorted(held):
        h, n = _added(*held.pop(b))
        word = h & _ONE == 0
        bits = _filled(h, _level(n))
        yield pa.RecordBatch.from_arrays(
            [pa.array([b], pa.int32()), pa.array([bits.tobytes()], pa.binary()),
             pa.array([h[word].tobytes() + n[word].tobytes()], pa.binary()), pa.array([n[word].sum()], pa.int64()),
             pa.array([word.sum()], pa.int64())], names=["block", "bits", "words", "n_tokens", "n_distinct"])


def _words(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of a block's single tokens."""
    x = np.frombuffer(blob, np.uint64)
    return x[:len(x) // 2], x[len(x) // 2:].view(np.int64)


def _frequent(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("words"):
                h, n = _words(blob.as_py())
                at = np.flatnonzero(n >= least)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(h[at])), pa.array(n[at])], names=["h", "n"])
    return run


@dataclass
class Model:
    """What scoring broadcasts (HOT bounds it), and on the driver the stored blocks."""

    hot: np.ndarray
    hot_n: np.ndarray
    n_tokens: int
    n_distinct: int
    n_docs: int
    blocks: DataFrame | None = None
    #: weight of the pair estimate by level of the context's count
    mixture: np.ndarray | None = None

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Quantised level of every n-gram hash, 0 if absent; reads the blocks that own them."""
        level, own = np.zeros(len(h), dtype=np.int64), block_of(h)
        for r in self.blocks.where(F.col("block").isin(np.unique(own).tolist())).select("block", "bits").toLocalIterator():
            at = np.flatnonzero(own == r.block)
            level[at] = probe(np.frombuffer(r.bits, np.uint8), h[at])
        return level


@contextmanager
def _exchanges_removed(spark: SparkSession) -> Iterator[None]:
    """Exchanges of the queries inside are of no use once their result is there."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """(model, stored blocks) of all given rows."""
    spark = docs.sparkSession
    path = scratch_path(spark, "ngrams")
    named = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    with _exchanges_removed(spark):
        (named.mapInArrow(_count, "block int, h binary, n binary").repartition("block").mapInArrow(_build, _BLOCK)
         .write.parquet(path))
    blocks = spark.read.schema(_BLOCK).parquet(path)
    total = blocks.agg(F.sum("n_tokens").alias("n"), F.sum("n_distinct").alias("k")).first()
    n_tokens, n_distinct = total.n or 0, total.k or 0
    hot = blocks.select("words").mapInArrow(_frequent(-(-n_tokens // HOT)), "h long, n long").toArrow()
    hot_h, hot_n = hot.column("h").to_numpy().view(np.uint64), hot.column("n").to_numpy()
    order = np.argsort(hot_h)
    end = np.array([_END & ~_ONE])
    n_docs = 0
    for r in blocks.where(F.col("block") == int(block_of(end)[0])).select("words").collect():
        h, n = _words(r.words)
        n_docs += int(n[h == end].sum())
    model = Model(hot_h[order], hot_n[order], n_tokens, n_distinct, n_docs, blocks)
    with _exchanges_removed(spark):
        fitted = docs if FIT_SHARE == 1 else docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(FIT_SHARE)) == 0)
        model.mixture = _fit(fitted, model, blocks)
    return model, blocks


#: Rows of the exchange, by kind: 0 a block (bits, words), 1 a request (pairs, single tokens) or its answer (levels, counts), 2 the
#: chunk's own rows, which only pass through.
_ROW = "block int, kind int, chunk long, data binary, more binary"
_NAMES = ["block", "kind", "chunk", "data", "more"]


def _exact(m: Model, kinds: np.ndarray) -> np.ndarray:
    """Counts of the hot tokens, -1 for the others."""
    n = np.full(len(kinds), -1, dtype=np.int64)
    if len(m.hot):
        at = np.minimum(np.searchsorted(m.hot, kinds), len(m.hot) - 1)
        is_hot = m.hot[at] == kinds
        n[is_hot] = m.hot_n[at[is_hot]]
    return n


def _ask(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(BLOCKS + 1)
        for batch in batches:
            for c in chunks(batch, "text", CHUNK_BYTES):
                tok, pair, _ = tokens(Words(c.column("text"), lower=True))
                kinds, pairs = np.unique(tok), np.unique(pair)
                cold = kinds[_exact(shared.value, kinds) < 0]
                chunk = c.column("rid")[0].as_py()
                cuts, more = np.searchsorted(block_of(pairs), every), np.searchsorted(block_of(cold), every)
                use = np.flatnonzero(np.diff(cuts) + np.diff(more))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(use, pa.int32()), pa.array(np.ones(len(use), np.int32)), pa.array(np.full(len(use), chunk, np.int64)),
                     _blobs(_packed(pairs), np.append(cuts[use], len(pairs))), _blobs(_packed(cold), np.append(more[use], len(cold)))],
                    names=_NAMES)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, c.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(c)
                owner = block_of(mix(np.array([chunk], dtype=np.int64).view(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner, pa.int32()), pa.array([2], pa.int32()), pa.array([chunk], pa.int64()),
                     pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([b""], pa.binary())], names=_NAMES)
    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by block and kind: a block comes before its requests, and one block is held at a time."""
    now, bits, words, counts = -1, np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        starts = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0))
        for lo, hi in zip(starts, [*starts[1:], len(block)], strict=True):
            part = batch.slice(lo, hi - lo)
            if block[lo] != now:
                now, bits, words, counts = block[lo], bits[:0], words[:0], counts[:0]
            if kind[lo] == 0:
                bits = np.frombuffer(part.column("data")[0].as_py(), np.uint8)
                words, counts = _words(part.column("more")[0].as_py())
                continue
            if kind[lo] == 1:
                pairs, cuts = flat(part.column("data"))
                cold, more = flat(part.column("more"))
                cold, more = _unpacked(cold, block[lo]), more // 7
                at = np.minimum(np.searchsorted(words, cold), max(len(words) - 1, 0))
                n = np.where(words[at] == cold, counts[at], 0) if len(words) else np.zeros(len(cold), np.int64)
                # Texts repeat each other's n-grams: every distinct one is probed once.
                pairs, back = np.unique(_unpacked(pairs, block[lo]), return_inverse=True)
                part = pa.RecordBatch.from_arrays(
                    [part.column("block"), part.column("kind"), part.column("chunk"),
                     _blobs(probe(bits, pairs).astype(np.uint8)[back], cuts // 7), _blobs(n, more)], names=_NAMES)
            yield part


def _looked_up(m: Model, group: pa.Table):
    """Of a chunk: its rows, document offsets, and for every token its count, its pair's level, its context's count and its pair's number."""
    kind = group.column("kind").to_numpy()
    stream = group.column("data")[int(np.flatnonzero(kind == 2)[0])].as_buffer()
    c = pa.ipc.open_stream(stream).read_next_batch()
    tok, pair, offs = tokens(Words(c.column("text"), lower=True))
    kinds, back = np.unique(tok, return_inverse=True)
    n, pair_back = _exact(m, kinds), np.unique(pair, return_inverse=True)[1]
    at = np.flatnonzero(kind == 1)
    at = at[np.argsort(group.column("block").to_numpy()[at])]
    got = group.select(["data", "more"]).take(pa.array(at)).combine_chunks()
    column = lambda name: flat(got.column(name).combine_chunks() if got.num_rows else pa.array([], pa.binary()))[0]
    n[n < 0] = column("more").copy().view(np.int64)
    n = n[back]
    before = np.empty(len(back), dtype=np.int64)
    before[1:] = n[:-1]
    before[offs[:-1]] = m.n_docs
    return c, offs, n, column("data").astype(np.int64)[pair_back], before, pair_back


def mixed(m: Model, n: np.ndarray, pair_level: np.ndarray, before: np.ndarray) -> np.ndarray:
    """P(token | context) from the token's count, the pair's level and the context's count."""
    weight = m.mixture[_level(before)]
    seen = np.minimum(1.0, _least(pair_level) / np.maximum(before, 1))
    return weight * seen + (1 - weight) * (n + 1) / (m.n_tokens + m.n_distinct + 1)


def _finish(shared, unit: float):
    def run(group: pa.Table) -> pa.Table:
        m: Model = shared.value
        c, offs, n, pair_level, before, _ = _looked_up(m, group)
        size = np.diff(offs)
        return pa.table({
            "doc_id": c.column("doc_id"), "n_tokens": size,
            "n_known": np.add.reduceat((n > 0).astype(np.int64), offs[:-1]),
            "train_tokens": np.full(len(size), m.n_tokens, dtype=np.int64),
            "base_score": np.add.reduceat(np.log10(n + 1.0), offs[:-1]) - size * unit,
            "score": np.add.reduceat(np.log10(mixed(m, n, pair_level, before)), offs[:-1])})
    return run


def _deleted(shared):
    """Log likelihoods of a chunk's tokens by level of the context and weight, each token taken out of the counts; weight -1: tokens."""
    def run(group: pa.Table) -> pa.Table:
        m: Model = shared.value
        _, _, n, pair_level, before, pair = _looked_up(m, group)
        # A pair has one value wherever it occurs; without a count left, the weight is a factor of its own.
        times, first = np.bincount(pair), np.empty(pair.max() + 1, dtype=np.int64)
        first[pair[::-1]] = np.arange(len(pair))[::-1]
        n, pair_level, before = n[first], pair_level[first], before[first]
        level = _level(before)
        seen = np.minimum(1.0, np.maximum(_least(pair_level) - 1, 0) / np.maximum(before - 1, 1))
        word = np.maximum(n, 1) / (m.n_tokens + m.n_distinct)
        sums = [np.bincount(level, times, LEVELS)]
        none = seen == 0
        count = np.bincount(level[none], times[none], LEVELS)
        fixed = np.bincount(level[none], times[none] * np.log(word[none]), LEVELS)
        level, seen, word, times = level[~none], seen[~none], word[~none], times[~none]
        sums += [fixed + count * math.log(1 - x) + np.bincount(level, times * np.log(x * seen + (1 - x) * word), LEVELS) for x in WEIGHTS]
        return pa.table({"level": np.tile(np.arange(LEVELS, dtype=np.int32), len(sums)),
                         "weight": np.repeat(np.arange(-1, len(WEIGHTS), dtype=np.int32), LEVELS), "value": np.concatenate(sums)})
    return run


def _fit(part: DataFrame, model: Model, blocks: DataFrame) -> np.ndarray:
    """Weight of the pair estimate for every level of the context's count: a half without any row to fit it."""
    shared, answers = _answers(part, model, blocks)
    sums = np.zeros((len(WEIGHTS) + 1, LEVELS))
    for r in (answers.groupBy("chunk").applyInArrow(_deleted(shared), "level int, weight int, value double")
              .groupBy("level", "weight").agg(F.sum("value").alias("value")).collect()):  # LEVELS x weights rows
        sums[r.weight + 1, r.level] = r.value
    count, gain = sums[0], sums[1:]
    if not count.sum():
        return np.where(np.arange(LEVELS) > 0, 0.5, 0.0)
    best = WEIGHTS[np.argmax(gain + LEAN * gain.sum(axis=1, keepdims=True) / count.sum(), axis=0)]
    return np.where(np.arange(LEVELS) > 0, best, 0.0)


def _answers(docs: DataFrame, model: Model, blocks: DataFrame):
    """(broadcast model, rows of every chunk with the answers of the blocks)."""
    m = Model(model.hot, model.hot_n, model.n_tokens, model.n_distinct, model.n_docs, mixture=model.mixture)
    shared = docs.sparkSession.sparkContext.broadcast(m)
    # The row number of a chunk's first row names the chunk within this plan.
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    held = blocks.select("block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chunk"), F.col("bits").alias("data"),
                         F.col("words").alias("more"))
    return shared, (rows.mapInArrow(_ask(shared), _ROW).unionByName(held).repartition("block").sortWithinPartitions("block", "kind")
                    .mapInArrow(_answer, _ROW))


def score(docs: DataFrame, model: Model, blocks: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), one row per input row."""
    shared, answers = _answers(docs, model, blocks)
    unit = math.log10(model.n_tokens + model.n_distinct + 1)
    return answers.groupBy("chunk").applyInArrow(
        _finish(shared, unit),
        "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
