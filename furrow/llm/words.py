"""Vectorised word tools over Arrow string columns.

A *word* is a maximal run of bytes other than space and U+0009..U+000D (the pattern ``[^\\x20\\x09-\\x0D]+``). UTF-8
continuation bytes are never separators, so byte runs and code-point runs agree.

Texts of one Arrow batch are handled as one byte buffer plus document offsets. Hashes are polynomial over the buffer's
prefix sums, so a hash of any byte run or word window costs one subtraction and one multiplication. All functions work on
bounded chunks (``chunks``); memory is proportional to the chunk or to the longest single text, whichever is larger.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
_SEP = np.zeros(256, dtype=bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3 constants): every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=None)
def _byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        base = (0x9E3779B97F4A7C15 * (2 * seed + 1) | 1) & (2**64 - 1)
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[seed] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


def release() -> None:
    """Hands freed memory back to the system: Python workers live on between the stages of a job."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def chunks(batch: pa.RecordBatch, column: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of the batch with at most max_bytes of text each (a longer single text is a chunk of its own)."""
    if batch.num_rows == 0:
        return
    _, offs = flat(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi
    release()


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets start at 0."""
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, dtype=np.int64 if large else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0]:offs[-1]], offs - offs[0]


class Words:
    """Words of a chunk of texts: byte spans, per-document ranges and hashes."""

    def __init__(self, col: pa.Array, lower: bool = False, seed: int = 0):
        buf, self.offs = flat(col)
        self.buf = _LOWER[buf] if lower else buf
        self.seed = seed
        self.n_docs = len(self.offs) - 1
        n = len(self.buf)
        word = ~_SEP[self.buf]
        first = np.zeros(n + 1, dtype=bool)
        first[self.offs] = True
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:] = word[:-1]
        before &= ~first[:n]
        after[:-1] = word[1:]
        after &= ~first[1:]
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.word_offs = np.searchsorted(self.starts, self.offs)
        self.counts = np.diff(self.word_offs)
        self._prefix: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def doc(self) -> np.ndarray:
        """Document index of every word."""
        return np.repeat(np.arange(self.n_docs), self.counts)

    def byte_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of byte runs [start, end)."""
        if self._prefix is None:
            p, _ = powers(len(self.buf) + 1, self.seed)
            self._prefix = np.zeros(len(self.buf) + 1, dtype=np.uint64)
            np.cumsum(_byte_codes(self.seed)[self.buf] * p[:-1], out=self._prefix[1:])
        _, inv = powers(len(self.buf) + 1, self.seed)
        return mix((self._prefix[ends] - self._prefix[starts]) * inv[starts])

    def hashes(self) -> np.ndarray:
        return self.byte_hash(self.starts, self.ends)

    def text(self, i: int) -> list[bytes]:
        """The words of document i."""
        lo, hi = self.word_offs[i], self.word_offs[i + 1]
        return self.buf[self.offs[i]:self.offs[i + 1]].tobytes().split() if hi > lo else []


def window_hashes(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of every window of `length` consecutive words over the whole sequence (document ends are the caller's)."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.uint64)
    p, inv = powers(n + 1, seed + 17)
    pre = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * p[:n], out=pre[1:])
    return mix((pre[length:] - pre[:-length]) * inv[:n + 1 - length] + np.uint64(length))


def window_inside(counts: np.ndarray, offs: np.ndarray, n: int, length: int) -> np.ndarray:
    """Mask over the n - length + 1 windows: those that lie within one document."""
    if n < length:
        return np.zeros(0, dtype=bool)
    left = np.repeat(offs[1:], counts) - np.arange(n)  # words from here to the end of the document
    return left[:n - length + 1] >= length


def as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list<long> column; null lists are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = np.zeros(len(col), dtype=np.int64)
    if len(col):
        sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = col.flatten().to_numpy(zero_copy_only=False) if len(col) else np.zeros(0, np.int64)
    return values, np.concatenate([[0], np.cumsum(sizes)])


def list_array(values: np.ndarray, offs: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32), pa.int32()), pa.array(values, kind))


def owner_key(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """One 64-bit key of a (hash, document index) pair, for set operations within a chunk."""
    return values.astype(np.uint64, copy=False) ^ mix(owner.astype(np.uint64) + np.uint64(0x51ED2701))


def distinct_per_owner(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Indices of the first row of every distinct (value, owner)."""
    return np.unique(owner_key(values, owner), return_index=True)[1]


def unused(name: str, columns: list[str]) -> str:
    """A column name that is not among those given (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
