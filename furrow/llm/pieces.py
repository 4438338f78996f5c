"""SentencePiece encoding by forward-filtering backward-sampling, and lossless decoding.

The vocabulary of a SentencePiece model file (its path is a parameter) is turned into piece weights: log-weight
``-log(2 + rank)`` per piece, the rank being the merge order for a merge-based model and the order of probability otherwise;
bytes of characters outside the vocabulary are far below every piece. All segmentations of a text form a lattice; a
segmentation's probability is proportional to the product of its pieces' weights, sharpened by ``1 / temperature``.

*Forward filtering* computes the log-weight of all ways to reach every position; *backward sampling* then draws the last
piece, the one before it, and so on, which gives exact samples. No piece holds a space after another character, so the lattice
falls into units (spaces plus the characters up to the next space): a chunk's distinct units are filtered once, all occurrences
are sampled together. Draws are a hash of (seed, row key, unit number, step) against integer weights, so a row's pieces depend
on nothing but its text, key and seed.

Encoding puts one space before a non-empty text, decoding drops it. A literal U+2581 is spelt in bytes, hence
``decode(encode(t)) == t`` for every text.

Defined edge cases: null text gives null pieces, empty text no pieces; a null key counts as 0; extra columns and repeated
rows pass through unchanged; an empty table gives an empty result; a space-free text is one unit of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.words import Words, chunks, flat, list_array, lists, mix, unused

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 20
_SPACE = "▁".encode()
_SCALE = np.int64(1 << 32)
_SEED = np.uint64(0xCBF29CE484222325)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Running hash of a byte string, extended by a byte."""
    return (state ^ byte.astype(np.uint64)) * _PRIME


@dataclass
class Vocabulary:
    """Pieces as bytes (the space mark as a space); bounded by the model file, so it can be broadcast."""

    data: np.ndarray       # bytes of all pieces
    offs: np.ndarray       # offsets by piece id
    longest: int           # bytes of the longest lattice piece
    kinds: np.ndarray      # by the top 20 bits of a hash: 2 may be a piece, 1 may begin one, 0 neither
    slots: np.ndarray      # by the top 22 bits of a hash: the first piece with them, or -1
    crowd: int             # most pieces with equal top bits
    ends: np.ndarray       # first and last byte of the lattice pieces
    hashes: np.ndarray     # sorted hashes of lattice pieces
    ids: np.ndarray        # their ids
    weight: np.ndarray     # log-weight by piece id
    byte_ids: np.ndarray   # id of every byte's piece


def load(path: str = MODEL_PATH) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    raw, lattice, byte_ids = [b""] * n, [], np.full(256, -1, dtype=np.int64)
    for i in range(n):
        if sp.is_byte(i):
            value = int(sp.id_to_piece(i)[1:-1], 16)
            byte_ids[value], raw[i] = i, bytes([value])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            raw[i] = sp.id_to_piece(i).encode().replace(_SPACE, b" ")
            lattice.append(i)
    if (byte_ids < 0).any():
        raise ValueError("the model needs byte fallback pieces for lossless decoding")
    if any(b" " in raw[i].lstrip(b" ") for i in lattice):
        raise ValueError("a piece holds a space after another character")
    order = sorted(lattice, key=lambda i: (-sp.get_score(i), i))
    weight = np.full(n, -30.0)
    weight[order] = -np.log(2.0 + np.arange(len(order)))
    kinds = np.zeros(1 << 20, dtype=np.uint8)
    hashes = np.empty(len(lattice), dtype=np.uint64)
    for j, i in enumerate(lattice):
        state = np.full(1, _SEED)
        for b in raw[i]:
            state = _step(state, np.array([b], dtype=np.uint8))
            kinds[state[0] >> np.uint64(44)] = 1
        hashes[j] = state[0]
    by = np.argsort(hashes)
    hashes, ids = hashes[by], np.array(lattice)[by]
    top, first, crowd = np.unique(hashes >> np.uint64(42), return_index=True, return_counts=True)
    kinds[hashes >> np.uint64(44)] = 2
    slots = np.full(1 << 22, -1, dtype=np.int32)
    slots[top] = first
    ends = np.array([(raw[i][0], raw[i][-1]) for i in ids], dtype=np.uint8)
    return Vocabulary(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]),
                      max(len(raw[i]) for i in lattice), kinds, slots, int(crowd.max()), ends, hashes, ids, weight, byte_ids)


class _Lattice:
    """Sampling tables of a set of distinct units (spans of one byte buffer).

    Units are ranked by length, longest first; the node at depth p of the unit of rank u is ``level[p] + u``, so the nodes of
    a depth, and with them the edges that end there, are neighbours."""

    def __init__(self, v: Vocabulary, buf: np.ndarray, offs: np.ndarray, temperature: float):
        size = np.diff(offs)
        n_units = len(size)
        by_size = np.argsort(-size, kind="stable")
        rank = np.empty(n_units, dtype=np.int64)
        rank[by_size] = np.arange(n_units)
        deepest = int(size.max())
        alive = np.searchsorted(-size[by_size], -np.arange(deepest + 1), side="right")  # units with a node at each depth
        level = np.concatenate([[0], np.cumsum(alive)])
        n_nodes = int(level[-1])
        level = level.astype(np.int32)
        pos = (np.arange(len(buf)) - np.repeat(offs[:-1], size)).astype(np.int32)
        left = np.repeat(size.astype(np.int32), size) - pos
        urank = np.repeat(rank.astype(np.int32), size)
        starts, sizes, idents = [], [], []
        at, h = np.arange(len(buf), dtype=np.int32), np.full(len(buf), _SEED)
        for n in range(1, v.longest + 1):  # positions whose next n bytes begin a piece
            if n > 1:
                ok = left[at] >= n
                at, h = at[ok], h[ok]
            if not len(at):
                break
            h = _step(h, buf[at + (n - 1)])
            kind = v.kinds[h >> np.uint64(44)]
            i = np.flatnonzero(kind == 2)
            slot = v.slots[h[i] >> np.uint64(42)]
            i, first = i[slot >= 0], slot[slot >= 0]
            who, want = at[i], h[i]
            piece = np.full(len(i), -1, dtype=np.int32)
            for k in range(v.crowd):  # pieces that share the top bits are neighbours
                j = np.minimum(first + k, len(v.hashes) - 1)
                same = (v.hashes[j] == want) & (v.ends[j, 0] == buf[who]) & (v.ends[j, 1] == buf[who + (n - 1)])
                piece[same] = v.ids[j[same]]
            got = piece >= 0
            starts.append(who[got])
            sizes.append(n)
            idents.append(piece[got])
            ok = kind > 0
            at, h = at[ok], h[ok]
        # Bytes of characters without a piece of their own.
        width = np.where(buf < 0x80, 1, np.where(buf < 0xE0, 2, np.where(buf < 0xF0, 3, 4))).astype(np.int8)
        own = np.zeros(len(buf), dtype=bool)
        for s, n in zip(starts, sizes, strict=True):
            if n <= 4:
                own[s[width[s] == n]] = True
        char = np.flatnonzero((buf & 0xC0) != 0x80)
        spelt = np.flatnonzero(~np.repeat(own[char], np.diff(np.append(char, len(buf))))).astype(np.int32)
        if len(spelt):
            starts.append(spelt)
            sizes.append(1)
            idents.append(v.byte_ids[buf[spelt]].astype(np.int32))

        # Edges by end node: counting first, then one pass per length.
        many = np.zeros(n_nodes, dtype=np.int32)
        for s, n in zip(starts, sizes, strict=True):
            many[level[pos[s] + n] + urank[s]] += 1  # a length has one edge per end
        self.head = np.concatenate([[0], np.cumsum(many)])
        free = self.head[:-1].copy()
        self.back = np.empty(self.head[-1], dtype=np.int32)
        self.ident = np.empty(self.head[-1], dtype=np.int32)
        while starts:
            s, n, ident = starts.pop(0), sizes.pop(0), idents.pop(0)
            e = level[pos[s] + n] + urank[s]
            slot = free[e]
            self.back[slot] = level[pos[s]] + urank[s]
            self.ident[slot] = ident
            free[e] += 1
        del free, pos, left, urank
        weight = v.weight / temperature
        alpha = np.zeros(n_nodes)
        run = np.empty(len(self.ident), dtype=np.int64)
        for p in range(1, deepest + 1):
            lo, hi = level[p], level[p + 1]
            e0, e1 = self.head[lo], self.head[hi]
            some = many[lo:hi] > 0  # none ends inside a character
            cut, k = self.head[lo:hi][some] - e0, many[lo:hi][some]
            x = alpha[self.back[e0:e1]] + weight[self.ident[e0:e1]]
            top = np.maximum.reduceat(x, cut)
            w = np.exp(x - np.repeat(top, k))
            total = np.add.reduceat(w, cut)
            alpha[lo:hi][some] = top + np.log(total)
            share = np.maximum(1, np.rint(w * np.repeat((1 << 30) / total, k))).astype(np.int64)
            c = np.cumsum(share)
            run[e0:e1] = c - np.repeat(c[cut] - share[cut], k)
        self.total = np.zeros(n_nodes, dtype=np.int64)
        has = many > 0
        self.total[has] = run[self.head[1:][has] - 1]
        run += np.repeat(np.arange(n_nodes) * _SCALE, many)
        self.cum = run
        self.n_units = n_units
        self.last_node = level[size] + rank

    def sample(self, unit: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, number of pieces per occurrence), pieces in text order."""
        node = self.last_node[unit]
        at, found, step = np.arange(len(unit)), [], 0
        count = np.zeros(len(unit), dtype=np.int64)
        while len(at):
            u = mix(seeds[at] + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(32)
            draw = (u * self.total[node].astype(np.uint64)) >> np.uint64(32)
            edge = np.searchsorted(self.cum, node * _SCALE + draw.astype(np.int64), side="right")
            found.append((at, self.ident[edge]))
            count[at] += 1
            node = self.back[edge]
            more = node >= self.n_units  # the nodes of depth 0 come first
            at, node = at[more], node[more]
            step += 1
        offs = np.cumsum(count)
        out = np.empty(int(count.sum()), dtype=np.int32)
        for k, (who, ident) in enumerate(found):
            out[offs[who] - 1 - k] = ident
        return out, count


def _units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a space before every non-empty text, unit starts, unit count per text)."""
    full = np.diff(offs) > 0
    data = np.insert(buf, offs[:-1][full], 32)
    doc_start = (offs[:-1] + np.cumsum(full) - full)[full]
    space = data == 32
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[doc_start] = True
    starts = np.flatnonzero(cut)
    per = np.zeros(len(full), dtype=np.int64)
    per[full] = np.diff(np.append(np.searchsorted(starts, doc_start), len(starts)))
    return data, starts, per


def encode_chunk(v: Vocabulary, texts: pa.Array, keys: np.ndarray, seed: int, temperature: float) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of all texts, offsets by text)."""
    buf, offs = flat(texts)
    data, starts, per = _units(buf, offs)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(per) + 1, np.int64)
    ends = np.append(starts[1:], len(data))
    view = Words.__new__(Words)
    attempt = 0
    while True:  # a second hash confirms that equal first hashes are equal units
        view.buf, view.seed, view._prefix = data, attempt, None
        kinds, first, back = np.unique(view.byte_hash(starts, ends), return_index=True, return_inverse=True)
        view.seed, view._prefix = attempt + 1, None
        check = view.byte_hash(starts, ends)
        if (check == check[first][back]).all():
            break
        attempt += 2
    size = (ends - starts)[first]
    unit_offs = np.concatenate([[0], np.cumsum(size)])
    picked = data[np.repeat(starts[first] - unit_offs[:-1], size) + np.arange(unit_offs[-1])]
    lattice = _Lattice(v, picked, unit_offs, temperature)
    doc = np.repeat(np.arange(len(per)), per)
    number = np.arange(len(starts)) - np.repeat(np.cumsum(per) - per, per)
    seeds = mix(mix(keys.astype(np.uint64) + np.uint64(seed * 0xA24BAED4963EE407 % 2**64))[doc] + number.astype(np.uint64))
    order = np.argsort(back, kind="stable")  # neighbours in the tables are sampled together
    pieces, count = lattice.sample(back[order], seeds[order])
    # Back to text order.
    sizes = np.empty_like(count)
    sizes[order] = count
    put = np.concatenate([[0], np.cumsum(sizes)])
    src = np.cumsum(count) - count
    out = np.empty_like(pieces)
    out[np.repeat(put[order] - src, count) + np.arange(len(pieces))] = pieces
    bounds = np.concatenate([[0], np.cumsum(per)])
    return out, put[bounds]


def decode_chunk(v: Vocabulary, ids: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Texts of lists of piece ids."""
    size = np.diff(v.offs)[ids]
    run = np.concatenate([[0], np.cumsum(size)])
    data = v.data[np.repeat(v.offs[ids] - run[:-1], size) + np.arange(run[-1])]
    ends = run[offs]
    full = np.flatnonzero(np.diff(ends) > 0)
    keep = np.ones(len(data), dtype=bool)
    keep[ends[full]] = False  # the space that encoding put there
    gone = np.zeros(len(ends), dtype=np.int64)
    gone[full + 1] = 1
    ends = ends - np.cumsum(gone)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()),
                                                             pa.py_buffer(data[keep].tobytes())]).cast(pa.string())


def _append(c: pa.RecordBatch, name: str, col: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*c.columns, col], names=[*c.schema.names, name])


def _with_nulls(col: pa.Array, like: pa.Array) -> pa.Array:
    return pa.compute.if_else(like.is_valid(), col, pa.scalar(None, col.type)) if like.null_count else col


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", key: str = "doc_id", seed: int = 0,
           temperature: float = 1.0, out: str = "pieces", decoded: str | None = None) -> DataFrame:
    """The rows with a column `out` (array<int>) of sampled piece ids; it replaces a column of that name. With `decoded` a
    column of that name holds the text decoded from the ids in the same task."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    src = docs.drop(out, *([decoded] if decoded else []))
    text_, key_ = (unused(c, docs.columns) for c in ("__text", "__key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, text_, CHUNK):
                keys = c.column(key_).fill_null(0).to_numpy()
                ids, offs = encode_chunk(shared.value, c.column(text_), keys, seed, temperature)
                made = _append(c.drop_columns([text_, key_]), out,
                               _with_nulls(list_array(ids, offs, pa.int32()), c.column(text_)))
                if decoded:
                    made = _append(made, decoded, _with_nulls(decode_chunk(shared.value, ids, offs), c.column(text_)))
                yield made

    schema = T.StructType([*src.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType())),
                           *([T.StructField(decoded, T.StringType())] if decoded else [])])
    return src.withColumns({text_: F.col(f"`{text}`"), key_: F.col(f"`{key}`").cast("long")}).mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, pieces: str = "pieces", out: str = "decoded") -> DataFrame:
    """The rows with a column `out` holding the text of the piece ids."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    src = rows.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offs = lists(batch.column(pieces))
            lo = 0
            while lo < batch.num_rows:  # about CHUNK pieces at a time
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK // 4, side="right")) - 1)
                hi = min(hi, batch.num_rows)
                part = batch.slice(lo, hi - lo)
                made = decode_chunk(shared.value, ids[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                yield _append(part, out, _with_nulls(made, part.column(pieces)))
                lo = hi

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(out, T.StringType())]))
