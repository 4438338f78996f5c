"""Vectors in blocks: rows assigned to cells around pivots, packed into bounded numpy blocks, compared block by block.

A *cell* holds the rows nearest to one pivot; it is cut into *rings* by distance from the pivot (quantiles of the cell), and a ring
is packed into blocks of at most ``BLOCK`` rows. Only (id, vector) goes through Python. The model (pivots, ring cuts) and the
directory (rows and distance range of every ring) are bounded by the number of pivots, never by the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from furrow.functions.hashing import h32

BLOCK = 512
RINGS = 16
MAX_PIVOTS = 4096
MODEL_BYTES = 64 << 20
#: Bytes of vectors of either side that meet in one group of a comparison, and the groups that a side is dealt to at least (if it has
#: that many blocks).
TILE = 32 << 20
GRID = 8
#: Rows of queries that are compared with a block at once.
STRIPE = 1024
#: Rounding allowance of distance bounds, relative to the distances compared.
EPS = 1e-9


def whole_vectors(df: DataFrame, key: str, vec: str, unit: bool = False) -> DataFrame:
    """(id, vec) with finite double vectors; others have no distance. With ``unit`` scaled to length 1 (zero vectors go)."""
    v = df.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    v = v.where(F.col("vec").isNotNull() & F.forall("vec", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    if unit:
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, c: a + c * c))
        v = v.withColumn("n", norm).where("n > 0").select("id", F.transform("vec", lambda c: c / F.col("n")).alias("vec"))
    return v


def lowest_hashed(rows: DataFrame, limit: int, seed: int) -> tuple[list, int]:
    """Up to `limit` rows of lowest seeded hash, and the number of all rows (estimated from the hashes beyond the limit)."""
    low = rows.select(h32("pivot", seed, F.col("id")).alias("h"), "id", "vec").orderBy("h", "id").limit(limit).collect()
    if len(low) < limit:
        return low, len(low)
    return low, max(len(low), int((limit - 1) * 2 ** 32 / max(low[-1]["h"], 1)))


@dataclass
class Cells:
    """Pivots, and by cell the rows, the ring cuts and the parts that a ring's rows are dealt to."""

    pivots: np.ndarray
    cuts: np.ndarray = field(default_factory=lambda: np.zeros((0, RINGS - 1)))
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def dim(self) -> int:
        return self.pivots.shape[1]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance) of each row."""
        cell = np.argmin((self.pivots ** 2).sum(axis=1) - 2 * (x @ self.pivots.T), axis=1)
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(axis=1))


def vectors(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def pick_pivots(rows: DataFrame, seed: int, n_pivots: int | None = None) -> Cells | None:
    """About sqrt(rows) pivots, but cells of a quarter block at least; None for an empty table."""
    low, n = lowest_hashed(rows, n_pivots or MAX_PIVOTS, seed)
    if not low:
        return None
    want = n_pivots or max(1, min(int(round(n ** 0.5)), 4 * n // BLOCK))
    dim = len(low[0]["vec"])
    want = max(1, min(want, MODEL_BYTES // (8 * dim)))
    return Cells(np.unique(np.array([r["vec"] for r in low[:want] if len(r["vec"]) == dim]), axis=0))


def assign(rows: DataFrame, cells: Cells) -> DataFrame:
    """(id, x, cell, r): the vector as bytes, the nearest cell and the distance from its pivot."""
    key = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", key), T.StructField("x", T.BinaryType()), T.StructField("cell", T.IntegerType()),
                           T.StructField("r", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = vectors(part, "vec", cells.dim)
                cell, r = cells.nearest(x)
                yield pa.RecordBatch.from_arrays([part.column("id"), _bytes(x), pa.array(cell.astype(np.int32)), pa.array(r)], schema.names)

    return rows.where(F.size("vec") == cells.dim).mapInArrow(run, schema)


def _bytes(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    offs = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offs), pa.py_buffer(x)])


def matrix(column: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    """Binary values of equal length as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dim)


def cut_rings(assigned: DataFrame, cells: Cells, rings: int = RINGS) -> Cells:
    """Ring cuts of every cell from quantiles of the distances; one small row a cell reaches the driver."""
    n_cells = len(cells.pivots)
    cuts, parts = np.full((n_cells, RINGS - 1), np.inf), np.ones(n_cells, dtype=np.int64)
    grid = F.percentile_approx("r", F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)]), F.lit(1000))
    for row in assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), grid.alias("q")).collect():
        m = int(min(max(-(-row.n // BLOCK), 1), rings))
        at = [row.q[int(round(i * RINGS / m)) - 1] for i in range(1, m)]
        cuts[row.cell, :len(at)] = at
        parts[row.cell] = max(1, row.n // (m * BLOCK * 8))
    return Cells(cells.pivots, cuts, parts)


def pack(assigned: DataFrame, cells: Cells) -> DataFrame:
    """Blocks of one ring each: cell, ring, n, low and high distance, ids, x. A hot ring is dealt to several tasks by id."""
    def ring(batches):
        for batch in batches:
            cell, r = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "r"))
            found = (r[:, None] > cells.cuts[cell]).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array(cells.parts[cell])],
                                             [*batch.schema.names, "ring", "parts"])

    dealt = assigned.mapInArrow(ring, T.StructType([*assigned.schema.fields, T.StructField("ring", T.IntegerType()),
                                                    T.StructField("parts", T.LongType())]))
    return packed(dealt.withColumn("part", F.pmod(F.xxhash64("id"), "parts")).drop("parts"))


def packed(dealt: DataFrame) -> DataFrame:
    """Blocks of (id, x, cell, r, ring, part) rows, each of one cell, ring and part."""
    schema = T.StructType([dealt.schema["cell"], T.StructField("ring", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()),
                           T.StructField("ids", T.ArrayType(dealt.schema["id"].dataType)), T.StructField("x", T.BinaryType())])
    dealt = dealt.repartition("cell", "ring", "part").sortWithinPartitions("cell", "ring", "part", "r")

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, n, r = t.column("id").combine_chunks(), t.num_rows, t.column("r").to_numpy()
        return pa.RecordBatch.from_arrays(
            [t.column(c).slice(0, 1).combine_chunks() for c in ("cell", "ring")]
            + [pa.array([n], pa.int64()), pa.array([r.min()]), pa.array([r.max()]),
               pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids), pa.array([b"".join(t.column("x").to_pylist())], pa.binary())],
            schema.names)

    def run(batches):
        held, rows, now = [], 0, None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "ring", "part")])
            edges = np.flatnonzero((np.diff(place, axis=1) != 0).any(axis=0)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                here = tuple(place[:, lo]) if hi > lo else now
                if held and here != now:
                    yield block(held)
                    held, rows = [], 0
                now = here
                while lo < hi:
                    step = min(hi - lo, BLOCK - rows)
                    held.append(batch.slice(lo, step))
                    lo, rows = lo + step, rows + step
                    if rows == BLOCK:
                        yield block(held)
                        held, rows = [], 0
        if held:
            yield block(held)

    return dealt.mapInArrow(run, schema)


@dataclass
class Directory:
    """Rows and distance range of every ring: at most RINGS entries a cell."""

    cell: np.ndarray
    ring: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(blocks: DataFrame) -> Directory:
        rows = sorted(blocks.groupBy("cell", "ring").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect())
        return Directory(*(np.array([r[i] for r in rows]) for i in range(5)))

    def bounds(self, x: np.ndarray, cells: Cells) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the distance from each row to the rows of each ring (triangle inequality)."""
        size = (x ** 2).sum(axis=1)[:, None] + (cells.pivots ** 2).sum(axis=1)
        d = np.sqrt(np.maximum(size - 2 * (x @ cells.pivots.T), 0))[:, self.cell]
        slack = EPS * (d + self.high) + 1e-7 * np.sqrt(size.max(axis=1, initial=0))[:, None]  # the root of a rounded difference
        return np.maximum(np.maximum(d - self.high, self.low - d) - slack, 0), d + self.high + slack

    def home(self, x: np.ndarray, cells: Cells, need: int) -> np.ndarray:
        """Mask (rows x rings): for each row the rings it lies in or next to, until they hold `need` rows."""
        low, high = self.bounds(x, cells)
        order = np.argsort(low + 1e-6 * high, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(low.shape, dtype=bool)
        np.put_along_axis(out, order, before < need, axis=1)
        return out


def exact_top(q: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, position in d, squared distance) of each query's k nearest rows by (distance, id).

    A matrix product finds the candidates; their distances are then summed left to right in double, as SQL does."""
    k = min(k, len(d))
    qq, dd = (q ** 2).sum(axis=1), (d ** 2).sum(axis=1)
    rough = qq[:, None] + dd - 2 * (q @ d.T)
    cut = np.partition(rough, k - 1, axis=1)[:, k - 1] if k < len(d) else np.full(len(q), np.inf)
    row, col = np.nonzero(rough <= (cut + 1e-9 * (qq + dd.max()) + 1e-300)[:, None])
    return top_pairs(q, d, row, col, ids, k)


def top_pairs(q: np.ndarray, d: np.ndarray, row: np.ndarray, col: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (row of q, position in d): each query's k nearest by (squared distance, id), with their distances."""
    dist = np.zeros(len(row))
    for j in range(q.shape[1]):
        diff = q[row, j] - d[col, j]
        dist += diff * diff
    order = np.lexsort((ids[col], dist, row))
    row, col, dist = row[order], col[order], dist[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], col[keep], dist[keep]


def parts_of(blocks: DataFrame, width: int) -> int:
    """Parts to deal blocks to, so that a part has about ``TILE`` bytes at ``width`` bytes a row."""
    n_blocks, n_rows = blocks.agg(F.count(F.lit(1)), F.sum(F.size("ids"))).first()
    return max(1, min(GRID, n_blocks), -(-(n_rows or 0) * width // TILE))


def meet(asks: DataFrame, store: DataFrame, grid: tuple[int, int], run: Callable[[pa.Table, pa.Table], pa.Table],
         schema: T.StructType) -> DataFrame:
    """``run(query blocks, store blocks)`` of every pair of a part of the queries with a part of the store.

    ``asks`` has ``qb`` and ``opened``, the codes of the store blocks a query block compares with; ``store`` has ``code`` and ``block``,
    a number of its own. A query block travels once for each part of the store, and a store block once for each part of the queries
    that opens it, however many query blocks that part has. ``grid`` is the number of parts of the queries and of the store.
    """
    n_tiles, n_slices = grid
    tile = F.pmod(F.xxhash64("qb"), F.lit(n_tiles))
    needed = asks.select(tile.alias("tile"), F.explode("opened").alias("code")).distinct()
    sent = store.join(needed, "code").withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(n_slices)))
    dealt = asks.withColumn("tile", tile).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_slices - 1).cast("long"))))
    kind = to_arrow_schema(schema)

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        return run(left, right).cast(kind)

    return dealt.groupBy("tile", "slice").cogroup(sent.groupBy("tile", "slice")).applyInArrow(group, schema)


class Opened:
    """The query rows of a table of query blocks, and which of them compare with a code."""

    def __init__(self, left: pa.Table, dim: int):
        self.ids = left.column("ids").combine_chunks()
        sizes = self.ids.value_lengths().to_numpy(zero_copy_only=False)
        self.start = np.append(0, np.cumsum(sizes))
        self.ids, self.qb = self.ids.flatten(), np.repeat(left.column("qb").to_numpy(), sizes)
        self.x = np.concatenate([values(v, dim) for v in left.column("x")])
        opened = left.column("opened").combine_chunks()
        block = np.repeat(np.arange(left.num_rows), opened.value_lengths().to_numpy(zero_copy_only=False))
        code = opened.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        self.code, self.block = code[order], block[order]

    def stripes(self, code: int) -> Iterator[np.ndarray]:
        """Positions of the query rows that compare with the code, in bounded pieces."""
        lo, hi = np.searchsorted(self.code, [code, code + 1])
        held, size = [], 0
        for b in self.block[lo:hi]:
            held.append(np.arange(self.start[b], self.start[b + 1]))
            size += len(held[-1])
            if size >= STRIPE:
                yield np.concatenate(held)
                held, size = [], 0
        if held:
            yield np.concatenate(held)


def values(v: pa.BinaryScalar, dim: int, kind=np.float64) -> np.ndarray:
    """A packed matrix, without a copy."""
    return np.frombuffer(v.as_buffer(), dtype=kind).reshape(-1, dim)


class Nearest:
    """The ``need`` nearest store rows, by (distance, rank), that every query row has met; ``cut`` is what a next one has to reach."""

    def __init__(self, cut: np.ndarray, need: int):
        self.cut = cut.copy()
        self.dist = np.full((len(cut), need), np.inf)
        self.rank = np.full((len(cut), need), np.iinfo(np.int64).max)

    def add(self, row: np.ndarray, dist: np.ndarray, rank: np.ndarray) -> None:
        """Pairs in order of row, at most ``need`` of each."""
        own, back = np.unique(row, return_inverse=True)
        place = np.arange(len(row)) - np.searchsorted(row, row)
        d, k = np.full((len(own), self.dist.shape[1]), np.inf), np.full((len(own), self.dist.shape[1]), np.iinfo(np.int64).max)
        d[back, place], k[back, place] = dist, rank
        d, k = np.concatenate([self.dist[own], d], axis=1), np.concatenate([self.rank[own], k], axis=1)
        order = np.lexsort((k, d), axis=1)[:, :self.dist.shape[1]]
        self.dist[own], self.rank[own] = np.take_along_axis(d, order, 1), np.take_along_axis(k, order, 1)
        self.cut[own] = np.minimum(self.cut[own], self.dist[own, -1])


def nearest_pairs(left: pa.Table, right: pa.Table, dim: int, need: int, other_ids: bool = False) -> pa.Table:
    """(qb, vid, did, distance): of the store blocks it opened, each query row's ``need`` nearest rows by (distance, id).

    A matrix product finds the candidates; their distances are then summed left to right in double, as SQL does. ``bound`` of the query
    blocks holds a squared distance for every row, beyond which nothing is looked for. With ``other_ids`` a row meets none of the same
    id."""
    asks = Opened(left, dim)
    dids = right.column("ids").combine_chunks()
    sizes = dids.value_lengths().to_numpy(zero_copy_only=False)
    base, dids = np.append(0, np.cumsum(sizes)), dids.flatten()
    place = pc.sort_indices(dids).to_numpy()  # nulls at the end
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    bound = np.concatenate([np.frombuffer(v.as_buffer()) for v in left.column("bound")])
    best, qq = Nearest(bound, need), (asks.x ** 2).sum(axis=1)
    if other_ids:
        names = pa.concat_arrays([asks.ids.cast(dids.type), dids]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        qname, dname = names[:len(asks.ids)], names[len(asks.ids):]
    for j, code in enumerate(right.column("code").to_numpy()):
        d = values(right.column("x")[j], dim)
        dd = (d ** 2).sum(axis=1)
        for row in asks.stripes(code):
            rough = asks.x[row] @ d.T
            rough *= -2
            rough += dd
            if other_ids:
                own = np.flatnonzero(np.isin(qname[row], dname[base[j]:base[j + 1]]))
                a, b = np.nonzero(qname[row[own], None] == dname[base[j]:base[j + 1]])
                rough[own[a], b] = np.nan
            cut = best.cut[row] - qq[row]
            free = np.flatnonzero(np.isinf(cut))
            if len(free) and need < len(d):
                cut[free] = np.partition(rough[free], need - 1, axis=1)[:, need - 1]
                cut[free[np.isnan(cut[free])]] = np.inf
            at, col = np.nonzero(rough <= (cut + 1e-9 * (qq[row] + dd.max()) + 1e-300)[:, None])
            if len(at):
                at, col, dist = top_pairs(asks.x, d, row[at], col, rank[base[j]:base[j + 1]], need)
                best.add(at, dist, rank[base[j] + col])
    at, k = np.nonzero(best.rank < len(place))
    return pa.table({"qb": asks.qb[at], "vid": asks.ids.take(pa.array(at)), "did": dids.take(pa.array(place[best.rank[at, k]])),
                     "distance": best.dist[at, k]})
