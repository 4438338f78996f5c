"""Token ids in compressed shard files: a Huffman-shaped wavelet matrix per shard.

*Writing.* Documents are range-partitioned and sorted by id, encoded and cut, at document ends, into shards of about
``shard_tokens`` ids; a task holds one shard at a time. Each shard becomes one file. Files of failed or repeated task attempts have
names of their own and are in no index, so a lost executor leaves at most unused files. The index (one row a shard, written with
Spark) gives every shard its place in the whole sequence: running sums within a range, plus the totals of the ranges before it.

*File.* The ids of a shard are coded by a Huffman code over the shard's own alphabet, with codes dealt so that at every level the
finished symbols come last in the matrix order. Level by level the sequence's code bits are one bit-plane; the next level holds the
zeros, then the ones, without the finished symbols. A directory counts the ones before every block of 1,024 bits. Thus a file is
near the zero-order entropy of its ids and supports, without being decoded: the id at a position (``token``), occurrences in a
range (``count``), the place of the k-th one (``locate``), and decoding of any range or of all. Layout, little-endian: magic, then
sizes (documents, ids, symbols, levels, bytes of the tables), the deflated tables (document ids and validity, document ends,
alphabet, counts, code lengths), then for each level its directory (uint32) and its plane (uint64 words), 8-byte aligned.

*Encoding.* A byte-level tokenizer without a normalizer splits before every white space that follows other characters and before
punctuation that follows a letter or digit, so the ids of a text are those of these units in a row; a worker encodes each distinct
unit once and keeps it.
Texts with an added token or white space outside ASCII are encoded whole, and so are all texts with any other kind of tokenizer.

Defined edge cases: a null text is empty (its document holds the end id alone); null document ids come first; equal ids are ordered
by a hash of the text, then the text, repeated rows are kept; extra columns are ignored; an empty table gives an index without rows;
a document longer than a shard is a shard of its own (memory grows with the longest text alone).
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.words import _SEP, chunks, flat
from furrow.session import drop_scratch, written

MAGIC = b"FWMTOK1\n"
_HEAD = struct.Struct("<8s5Q")
BLOCK = 1024
SHARD_TOKENS = 1 << 22
CHUNK = 1 << 23
RANGE_BYTES = 1 << 25
MAX_RANGES = 20_000
#: Encoded units that a worker keeps (the table is emptied beyond that, or after a unit of many characters).
_CACHE_UNITS, _CACHE_LENGTH = 1_000_000, 1_000
_JOINED = 10_000
_ALNUM, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_MARK[33:127] = ~_ALNUM[33:127]
#: Fixed value: white space outside ASCII, and the ASCII separators that some tools take for white space.
_WIDE_SPACE = "[\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


# code and planes ------------------------------------------------------------------------------------------------------------

def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code length of every symbol; a single symbol gets one bit."""
    n = len(counts)
    if n < 2:
        return np.ones(n, dtype=np.int64)
    order = np.argsort(counts, kind="stable")
    weight = counts[order].tolist() + [0] * (n - 1)
    parent = [0] * (2 * n - 1)
    leaf, node = 0, n
    for new in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if leaf < n and (node >= new or weight[leaf] <= weight[node]):
                pick, leaf = leaf, leaf + 1
            else:
                pick, node = node, node + 1
            total += weight[pick]
            parent[pick] = new
        weight[new] = total
    depth = [0] * (2 * n - 1)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[parent[i]] + 1
    out = np.empty(n, dtype=np.int64)
    out[order] = depth[:n]
    return out


def assign_codes(lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(left-aligned 64-bit code by symbol, symbols finished after each level in matrix order): finished symbols are last."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    inner, done = np.zeros(1, dtype=np.uint64), []
    for level in range(1, int(lengths.max(initial=0)) + 1):
        if level > 64:
            raise ValueError("code of over 64 bits")
        children = np.concatenate([inner, inner | np.uint64(1 << (64 - level))])
        symbols = np.flatnonzero(lengths == level)
        cut = len(children) - len(symbols)
        codes[symbols] = children[cut:][:len(symbols)]
        inner = children[:cut]
        done.append(symbols)
    return codes, done


def _pack(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ones before every block, words) of a bit-plane; bit i is bit i % 64 of word i // 64."""
    size = -(-len(bits) // BLOCK) * BLOCK
    packed = np.zeros(size // 8, dtype=np.uint8)
    small = np.packbits(bits, bitorder="little")
    packed[:len(small)] = small
    words = packed.view(np.uint64)
    ones = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(axis=1)
    return np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32), words


def shard_bytes(ids: np.ndarray, doc_ids: pa.Array, ends: np.ndarray) -> bytes:
    """The file of a shard: its ids (unsigned, 32 bits), document ids and the end of every document within the shard."""
    if len(ids) >= 2 ** 32:
        raise ValueError("a shard holds fewer than 2**32 ids")
    top = int(ids.max(initial=0)) + 1
    if top <= max(1 << 17, 4 * len(ids)):
        counts = np.bincount(ids, minlength=top)
        alphabet = np.flatnonzero(counts)
        place = np.zeros(top, dtype=np.int32)
        place[alphabet] = np.arange(len(alphabet))
        counts = counts[alphabet]
    else:
        alphabet, counts = np.unique(ids, return_counts=True)
        place = None
    lengths = code_lengths(counts)
    codes, done = assign_codes(lengths)
    wide = int(lengths.max(initial=0)) > 32
    codes = codes if wide else (codes >> np.uint64(32)).astype(np.uint32)
    top_bit = codes.dtype.type(1 << (63 if wide else 31))
    x = codes[place[ids] if place is not None else np.searchsorted(alphabet, ids)]
    planes = []
    for symbols in done:
        ones = x >= top_bit
        planes.append(_pack(ones))
        x <<= codes.dtype.type(1)
        below = np.empty_like(x)
        zeros = len(x) - np.count_nonzero(ones)
        np.compress(~ones, x, out=below[:zeros])
        np.compress(ones, x, out=below[zeros:])
        x = below[:len(x) - int(counts[symbols].sum())]
    known = doc_ids.is_valid().to_numpy(zero_copy_only=False)
    tables = zlib.compress(b"".join([
        doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), known.astype(np.uint8).tobytes(),
        ends.astype("<i8").tobytes(), alphabet.astype("<u4").tobytes(), counts.astype("<u4").tobytes(),
        lengths.astype(np.uint8).tobytes()]), 6)
    parts = [_HEAD.pack(MAGIC, len(doc_ids), len(ids), len(alphabet), len(done), len(tables)), tables]
    parts.append(b"\0" * (-(len(parts[0]) + len(tables)) % 8))
    for part in chain.from_iterable(planes):
        parts += [part.tobytes(), b"\0" * (-part.nbytes % 8)]
    return b"".join(parts)


def _aligned(n: int) -> int:
    return -(-n // 8) * 8


class Shard:
    """A shard file, in memory or mapped: access, counting and lookup on the planes as they are."""

    def __init__(self, data):
        raw = np.frombuffer(data, dtype=np.uint8)
        magic, docs, self.size, symbols, levels, packed = _HEAD.unpack(raw[:_HEAD.size].tobytes())
        if magic != MAGIC:
            raise ValueError("not a token shard")
        table, at, parts = zlib.decompress(raw[_HEAD.size:_HEAD.size + packed].tobytes()), 0, []
        for kind, n in (("<i8", docs), ("u1", docs), ("<i8", docs), ("<u4", symbols), ("<u4", symbols), ("u1", symbols)):
            parts.append(np.frombuffer(table, dtype=kind, count=n, offset=at))
            at += parts[-1].nbytes
        ids, known, self.ends, self.alphabet, counts, lengths = parts
        self.doc_ids = pa.array(ids, pa.int64(), mask=known == 0)
        self.counts, self.lengths = counts.astype(np.int64), lengths.astype(np.int64)
        self.codes, self.done = assign_codes(self.lengths)
        self.sizes, self.ranks, self.words = [self.size], [], []
        at = _aligned(_HEAD.size + packed)
        for symbols in self.done[:levels]:
            blocks = -(-self.sizes[-1] // BLOCK)
            self.ranks.append(raw[at:at + 4 * (blocks + 1)].view("<u4"))
            at += _aligned(4 * (blocks + 1))
            self.words.append(raw[at:at + blocks * BLOCK // 8].view("<u8"))
            at += blocks * BLOCK // 8
            self.sizes.append(self.sizes[-1] - int(self.counts[symbols].sum()))
        self.zeros = [n - int(r[-1]) for n, r in zip(self.sizes, self.ranks)]

    # planes

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position of a plane."""
        words, word = self.words[level], at >> 6
        near = (at >> 10)[:, None] * (BLOCK // 64) + np.arange(BLOCK // 64)
        inside = np.bitwise_count(words[np.minimum(near, len(words) - 1)]).astype(np.int64) * (near < word[:, None])
        part = words[np.minimum(word, len(words) - 1)] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.ranks[level][at >> 10].astype(np.int64) + inside.sum(axis=1) + np.bitwise_count(part)

    def _select(self, level: int, k: int, one: bool) -> int:
        """Position of the k-th one (or zero) of a plane."""
        rank = self.ranks[level]
        before = (lambda b: int(rank[b])) if one else (lambda b: b * BLOCK - int(rank[b]))
        block = bisect_right(range(len(rank)), k, key=before) - 1
        words = self.words[level][block * BLOCK // 64:(block + 1) * BLOCK // 64]
        bits = np.unpackbits(words.view(np.uint8), bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == int(one))[k - before(block)])

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.words[level].view(np.uint8), count=self.sizes[level], bitorder="little").astype(bool)

    def _path(self, symbol: int) -> list[bool]:
        return [bool(int(self.codes[symbol]) >> (63 - i) & 1) for i in range(int(self.lengths[symbol]))]

    def _symbol(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def _down(self, symbol: int, at: np.ndarray) -> np.ndarray:
        for level, one in enumerate(self._path(symbol)):
            ones = self._rank(level, at)
            at = self.zeros[level] + ones if one else at - ones
        return at

    # use

    def slice(self, low: int, high: int) -> np.ndarray:
        """The ids at positions low..high - 1, each by a walk down the planes."""
        out = np.zeros(max(high - low, 0), dtype=np.uint32)
        at, row = np.arange(low, max(high, low)), np.arange(len(out))
        for level, symbols in enumerate(self.done):
            if not len(at):
                break
            ones = self._rank(level, at)
            bit = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            end = at >= self.sizes[level + 1]
            starts = self.sizes[level + 1] + np.cumsum(self.counts[symbols])
            out[row[end]] = self.alphabet[symbols[np.searchsorted(starts, at[end], side="right")]]
            at, row = at[~end], row[~end]
        return out

    def token(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    def document(self, j: int) -> np.ndarray:
        """The ids of the j-th document of the shard, with its end id."""
        return self.slice(int(self.ends[j - 1]) if j else 0, int(self.ends[j]))

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences at positions low..high - 1."""
        symbol = self._symbol(token)
        if symbol is None:
            return 0
        if low == 0 and high is None:
            return int(self.counts[symbol])
        a, b = self._down(symbol, np.array([low, self.size if high is None else high]))
        return int(b - a)

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0)."""
        symbol = self._symbol(token)
        if symbol is None or not 0 <= k < self.counts[symbol]:
            raise IndexError("no such occurrence")
        path = self._path(symbol)
        at = int(self._down(symbol, np.zeros(1, np.int64))[0]) + k
        for level in range(len(path) - 1, -1, -1):
            at = self._select(level, at - self.zeros[level] if path[level] else at, path[level])
        return at

    def positions(self, token: int) -> np.ndarray:
        """All positions of an id, in order."""
        symbol = self._symbol(token)
        if symbol is None:
            return np.zeros(0, dtype=np.int64)
        path = self._path(symbol)
        at = int(self._down(symbol, np.zeros(1, np.int64))[0]) + np.arange(self.counts[symbol])
        for level in range(len(path) - 1, -1, -1):
            bits = self._bits(level)
            at = np.flatnonzero(bits)[at - self.zeros[level]] if path[level] else np.flatnonzero(~bits)[at]
        return at

    def tokens(self) -> np.ndarray:
        """All ids, rebuilt from the last level up."""
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        below = np.zeros(0, dtype=kind)
        for level in range(len(self.done) - 1, -1, -1):
            symbols = self.done[level]
            below = np.concatenate([below, np.repeat(symbols.astype(kind), self.counts[symbols])])
            bits = self._bits(level)
            here = np.empty(len(bits), dtype=kind)
            here[~bits], here[bits] = below[:self.zeros[level]], below[self.zeros[level]:]
            below = here
        return self.alphabet[below].astype(np.uint32)


# encoding -------------------------------------------------------------------------------------------------------------------

def _unit_cuts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of all units, and the end: texts, white space after other bytes, and ASCII punctuation after an ASCII letter or digit."""
    space = _SEP[buf]
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[1:-1] = (space[1:] & ~space[:-1]) | (_MARK[buf[1:]] & _ALNUM[buf[:-1]])
    cut[offs] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts with an end id each."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool, self.end = Tokenizer.from_file(path), end_id
        state = json.loads(self.tool.to_str())
        split = state["pre_tokenizer"] or {}
        self.by_unit = (state["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                        and not split.get("add_prefix_space"))
        added = [t["content"] for t in state["added_tokens"]]
        self.whole = "|".join([_WIDE_SPACE, *("".join(f"\\x{{{ord(c):x}}}" for c in t) for t in added)])
        self.bytes = np.zeros(self.tool.get_vocab_size(), dtype=np.int64)
        for token, i in self.tool.get_vocab().items():
            self.bytes[i] = len(token)
        self._forget()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _rows(self, units: list[str]) -> np.ndarray:
        """Row of every unit in the table of known units; new ones are encoded."""
        if len(self.ends) > _CACHE_UNITS:
            self._forget()
        rows = self.rows
        new = [u for u in units if u not in rows]
        spaced = [u for u in new if u[0] == " " and u[-1] not in " \t\n\v\f\r"]
        for lo in range(0, len(spaced), _JOINED):
            self._join(spaced[lo:lo + _JOINED])
        rest = [u for u in new if u not in rows]
        for u, ids in zip(rest, self._encode(rest)):
            rows[u] = self._add(ids)
        return np.fromiter((rows[u] for u in units), np.int64, len(units))

    def _add(self, ids: list[int]) -> int:
        """A row of ids in the pool."""
        self.pool.extend(ids)
        self.ends.append(len(self.pool))
        return len(self.ends) - 2

    def _join(self, units: list[str]) -> None:
        """Encodes units that begin with a space and end otherwise as one text; the bytes of the ids give each unit's share."""
        ids = np.array(self._encode(["".join(units)])[0], dtype=np.int64)
        at = np.concatenate([[0], np.cumsum(self.bytes[ids])])
        want = np.cumsum([len(u.encode()) for u in units])
        cut = np.searchsorted(at, want)
        if at[-1] != want[-1] or (at[cut] != want).any():
            return  # not a tokenizer whose ids tile the bytes: each unit is encoded alone
        first = len(self.ends) - 1
        self.rows.update(zip(units, range(first, first + len(units))))
        self.ends.extend((len(self.pool) + cut).tolist())
        self.pool.extend(ids.tolist())

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.pool, self.ends = array("I", [self.end]), array("q", [0, 1])  # row 0 is the end id

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        texts = texts.fill_null("") if texts.null_count else texts
        if self.by_unit:
            whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        else:
            whole = np.ones(len(texts), dtype=bool)
        buf, offs = flat(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        cuts = _unit_cuts(buf, offs)
        wide = len(buf) >= 2 ** 31
        units = pa.Array.from_buffers(pa.large_string() if wide else pa.string(), len(cuts) - 1,
                                      [None, pa.py_buffer(cuts.astype(np.int64 if wide else np.int32)), pa.py_buffer(buf)]).dictionary_encode()
        names = units.dictionary.to_pylist()
        rows = self._rows(names)[units.indices.to_numpy(zero_copy_only=False)]
        ends_at = np.searchsorted(cuts, offs[1:])  # the unit after each text
        direct = [self._add(ids) for ids in self._encode(texts.filter(pa.array(whole)).to_pylist())]
        final = ends_at + np.arange(len(ends_at)) + np.cumsum(whole)  # the end row of each text, after its units or its own row
        added = np.zeros(len(ends_at) + len(direct), dtype=np.int64)
        added[np.cumsum(1 + whole)[whole] - 2] = direct
        rows = np.insert(rows, np.repeat(ends_at, 1 + whole), added)
        ends, pool = np.frombuffer(self.ends, np.int64), np.frombuffer(self.pool, np.uint32)
        kind = np.int32 if len(pool) + len(buf) + len(rows) < 2 ** 31 else np.int64
        start = ends[rows].astype(kind)
        size = ends[rows + 1].astype(kind) - start
        last = np.cumsum(size, dtype=kind)
        out = pool[np.repeat(start - last + size, size) + np.arange(int(last[-1]) if len(last) else 0, dtype=kind)]
        del ends, pool
        if max(map(len, names), default=0) > _CACHE_LENGTH:
            self._forget()
        return out, np.diff(last[final].astype(np.int64), prepend=0)


@lru_cache(maxsize=2)
def _encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


# files ----------------------------------------------------------------------------------------------------------------------

def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and inner path of a folder of the shared store."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pa.fs.LocalFileSystem(), path) if path.startswith("/") else pa.fs.FileSystem.from_uri(path)


def open_shard(path: str) -> Shard:
    """A shard of the store; a local file is mapped, so that lookups read only the pages they touch."""
    store, inner = _store(path)
    if isinstance(store, pa.fs.LocalFileSystem):
        return Shard(pa.memory_map(inner).read_buffer())
    with store.open_input_file(inner) as f:
        return Shard(f.read_buffer())


_INDEX = "part int, seq int, path string, n_docs long, n_tokens long, n_bytes long"


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes (doc_id, text) rows into shard files under `folder`, in ascending doc_id order.

    Returns the index, written to the shared folder: part, seq, path, n_docs, n_tokens, n_bytes and start (ids before the shard).
    The driver holds one total per range (at most MAX_RANGES), as any numbering of partitions does."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(max(-(-n_bytes // RANGE_BYTES), 1), MAX_RANGES)
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(ranges, F.asc_nulls_first("doc_id"), tie).sortWithinPartitions(F.asc_nulls_first("doc_id"), tie, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, []
        encoder = _encoder(tokenizer_path, end_id)
        store, inner = _store(folder)

        def flush():
            nonlocal seq, held
            ids, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            names = pa.concat_arrays([h[2] for h in held])
            data = shard_bytes(ids, names, np.cumsum(n))
            name = f"tokens-{part:05d}-{seq:05d}-{uuid.uuid4().hex[:12]}.fwm"
            with store.open_output_stream(f"{inner}/{name}") as f:
                f.write(data)
            row = (part, seq, f"{folder}/{name}", len(n), len(ids), len(data))
            seq, held = seq + 1, []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
                row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                ["part", "seq", "path", "n_docs", "n_tokens", "n_bytes"])

        for batch in batches:
            for chunk in chunks(batch, "text", CHUNK):
                ids, n = encoder.encode(chunk.column("text"))
                names = chunk.column("doc_id")
                ends, low = np.cumsum(n), 0
                while low < len(n):  # cut at the document end that fills the shard
                    have = sum(len(h[0]) for h in held)
                    before = int(ends[low - 1]) if low else 0
                    high = min(int(np.searchsorted(ends, before + shard_tokens - have)) + 1, len(n))
                    held.append((ids[before:int(ends[high - 1])], n[low:high], names.slice(low, high - low)))
                    low = high
                    if sum(len(h[0]) for h in held) >= shard_tokens:
                        yield flush()
        if held:
            yield flush()

    _store(folder)[0].create_dir(_store(folder)[1], recursive=True)
    shards = written(ordered.mapInArrow(write, _INDEX), "shards")
    totals = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    bases = np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()
    base = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, bases)], "part int, base long")
    inside = Window.partitionBy("part").orderBy("seq")
    index = written(shards.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
                    .drop("base"), "token-index")
    drop_scratch(shards)
    return index


def _spread(index: DataFrame) -> DataFrame:
    """One task for about every eight shards."""
    return index.repartition(max(1, -(-index.count() // 8)))


def read_documents(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; ids_crc32 is over its ids as little-endian uint32."""
    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard = open_shard(path)
                data = memoryview(shard.tokens().astype("<u4")).cast("B")
                ends = shard.ends.tolist()
                starts = [0, *ends[:-1]]
                sums = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [shard.doc_ids, pa.array([start + a for a in starts], pa.int64()), pa.array(np.diff(shard.ends, prepend=0), pa.int64()),
                     pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _spread(index).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_counts(index: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of given ids over all shards, from the files' tables."""
    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                shard = open_shard(path)
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())],
                                                 ["token", "n"])

    return _spread(index).mapInArrow(read, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_token(index: DataFrame, token: int) -> DataFrame:
    """(doc_id, position, offset) of every occurrence of an id: place in the whole sequence and within its document."""
    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard = open_shard(path)
                at = shard.positions(token)
                doc = np.searchsorted(shard.ends, at, side="right")
                first = np.concatenate([[0], shard.ends])[doc]
                yield pa.RecordBatch.from_arrays([shard.doc_ids.take(pa.array(doc)), pa.array(at + start), pa.array(at - first)],
                                                 ["doc_id", "position", "offset"])

    return _spread(index).mapInArrow(read, "doc_id long, position long, offset long")
