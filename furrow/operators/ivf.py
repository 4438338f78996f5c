"""Approximate neighbours: an inverted file with product-quantised residuals, stored, re-read and searched by cell.

*Fit* (on at most ``SAMPLE`` rows of lowest seeded hash, the documented bound): k-means centroids, about sqrt(N) of them; residuals
are cut into sub-vectors with up to 256 codes each. The same sample calibrates the search: on ``CALIBRATION`` of its rows, how many
cells must be probed, and how much worse than the k-th best quantised distance a true neighbour may look, to keep ``TARGET`` of the
sample's true neighbours at each step. Neighbours in a sample are farther apart than in all rows, so the calibration is cautious.

*Build*: every row is encoded and stored in blocks by cell: ids, codes and vectors as separate columns, so a search reads codes of
probed cells only and vectors of candidates' blocks only.

*Search*: query blocks meet the code blocks of their probed cells in an equi-join; table lookups give quantised distances; rows
within the calibrated slack of the k-th best are re-ranked by exact distance. No candidate count is capped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators import vecblocks
from furrow.operators.vecblocks import Cells, exact_top, lowest_hashed, matrix, pack, top_pairs, whole_vectors
from furrow.session import drop_scratch, written

SAMPLE = 20_000
CALIBRATION = 256
CODES = 256
SUB_DIM = 8
TARGET = 0.98
ASKS = 256
#: Candidates that a task holds before it hands them on.
HELD = 1 << 16
_ROUNDS = 12


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from distinct starting rows; an empty cluster restarts at the row farthest from its centre."""
    r = np.random.default_rng(seed)
    start = np.unique(x, axis=0)
    centres = start[r.permutation(len(start))[:k]]
    for _ in range(_ROUNDS):
        cell = np.argmin((centres ** 2).sum(axis=1) - 2 * (x @ centres.T), axis=1)
        n = np.bincount(cell, minlength=len(centres))
        total = np.stack([np.bincount(cell, weights=column, minlength=len(centres)) for column in x.T], axis=1)
        far = np.argsort(-((x - centres[cell]) ** 2).sum(axis=1), kind="stable")
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[far[:len(empty)]]
    return centres


@dataclass
class Quantiser:
    """Centroids, codebooks and the calibrated search settings; bounded by the sample, never by the rows."""

    centroids: np.ndarray
    books: list[np.ndarray]
    probes: int = 1
    slack: float = 0.0

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.books), axis=1)

    def encode(self, residual: np.ndarray) -> np.ndarray:
        return np.stack([np.argmin((b ** 2).sum(axis=1) - 2 * (p @ b.T), axis=1) for p, b in zip(self.parts(residual), self.books)],
                        axis=1).astype(np.uint8)

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distance of each query residual from each coded row, by table lookup."""
        out = np.zeros((len(residual), len(codes)))
        for j, (p, b) in enumerate(zip(self.parts(residual), self.books)):
            out += ((p ** 2).sum(axis=1)[:, None] + (b ** 2).sum(axis=1) - 2 * (p @ b.T))[:, codes[:, j]]
        return np.sqrt(np.maximum(out, 0))

    def probed(self, x: np.ndarray) -> np.ndarray:
        """Mask (rows x cells) of the nearest ``probes`` cells."""
        d = (self.centroids ** 2).sum(axis=1) - 2 * (x @ self.centroids.T)
        order = np.argsort(d, axis=1, kind="stable")[:, :self.probes]
        out = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(out, order, True, axis=1)
        return out


def fit(rows: DataFrame, k: int = 3, seed: int = 7, cells: int | None = None) -> Quantiser | None:
    """A quantiser of (id, vec) rows; None for an empty table."""
    low, n = lowest_hashed(rows, SAMPLE, seed)
    if not low:
        return None
    dim = len(low[0]["vec"])
    x = np.array([r["vec"] for r in low if len(r["vec"]) == dim])
    want = cells or max(1, min(int(round(n ** 0.5)), len(x) // 8, vecblocks.MAX_PIVOTS, vecblocks.MODEL_BYTES // (8 * dim)))
    centroids = kmeans(x, want, seed)
    cell, _ = Cells(centroids).nearest(x)
    residual = x - centroids[cell]
    subs = np.array_split(residual, max(1, -(-dim // SUB_DIM)), axis=1)
    q = Quantiser(centroids, [kmeans(s, min(CODES, max(1, len(x) // 4)), seed) for s in subs])
    return _calibrate(q, x, cell, k)


def _calibrate(q: Quantiser, x: np.ndarray, cell: np.ndarray, k: int) -> Quantiser:
    asked = x[:CALIBRATION]
    if len(x) <= k + 1:
        q.probes, q.slack = len(q.centroids), np.inf
        return q
    row, col, _ = exact_top(asked, x, np.arange(len(x)), k + 1)
    keep = row != col
    row, col = row[keep], col[keep]
    order = np.argsort((q.centroids ** 2).sum(axis=1) - 2 * (asked @ q.centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)[row, cell[col]]
    q.probes = int(np.quantile(place, TARGET, method="higher")) + 1
    codes, opened = q.encode(x - q.centroids[cell]), q.probed(asked)
    seen = np.full((len(asked), len(x)), np.inf)
    for c in range(len(q.centroids)):
        own, here = np.flatnonzero(opened[:, c]), np.flatnonzero(cell == c)
        if len(own) and len(here):
            seen[np.ix_(own, here)] = q.distances(asked[own] - q.centroids[c], codes[here])
    seen[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    kth = np.partition(seen, k - 1, axis=1)[:, k - 1]
    worse = seen[row, col] - kth[row]
    worse = worse[np.isfinite(worse)]
    q.slack = max(0.0, float(np.quantile(worse, TARGET, method="higher"))) if len(worse) else np.inf
    return q


def build(docs: DataFrame, path: str, k: int = 3, seed: int = 7) -> None:
    """Fits on and indexes (did, dvec): ``<path>/model`` and ``<path>/blocks`` are written. An empty store writes an empty model."""
    spark = docs.sparkSession
    rows = whole_vectors(docs, "did", "dvec")
    q = fit(rows, k, seed)
    model = [] if q is None else [("centroid", -1, v.tolist()) for v in q.centroids]
    model += [] if q is None else [("code", j, v.tolist()) for j, b in enumerate(q.books) for v in b]
    model += [] if q is None else [("search", -1, [float(q.probes), float(q.slack)])]
    spark.createDataFrame([(i, *m) for i, m in enumerate(model)], "row int, kind string, part int, vec array<double>") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    if q is None:
        return
    cells, m = Cells(q.centroids), len(q.books)
    assigned = written(vecblocks.assign(rows, cells), "ivf-rows")
    blocks = pack(assigned, vecblocks.cut_rings(assigned, cells, rings=1))

    def encode(batches):
        for batch in batches:
            codes = []
            for c, x in zip(batch.column("cell").to_pylist(), batch.column("x").to_pylist()):
                codes.append(q.encode(np.frombuffer(x).reshape(-1, q.dim) - q.centroids[c]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("n"), batch.column("ids"), pa.array(codes, pa.binary()), batch.column("x")],
                                             ["cell", "n", "ids", "codes", "x"])

    schema = T.StructType([blocks.schema["cell"], blocks.schema["n"], blocks.schema["ids"], T.StructField("codes", T.BinaryType()), blocks.schema["x"]])
    coded = blocks.mapInArrow(encode, schema).withColumn("block", F.monotonically_increasing_id())
    coded.write.mode("overwrite").parquet(f"{path}/blocks")
    drop_scratch(assigned)


def load(spark: SparkSession, path: str) -> tuple[Quantiser | None, DataFrame | None]:
    """(quantiser, blocks) of a stored index."""
    rows = sorted(spark.read.parquet(f"{path}/model").collect())
    if not rows:
        return None, None
    centroids = np.array([r["vec"] for r in rows if r["kind"] == "centroid"])
    parts = sorted({r["part"] for r in rows if r["kind"] == "code"})
    books = [np.array([r["vec"] for r in rows if r["kind"] == "code" and r["part"] == j]) for j in parts]
    probes, slack = next(r["vec"] for r in rows if r["kind"] == "search")
    return Quantiser(centroids, books, int(probes), slack), spark.read.parquet(f"{path}/blocks")


def search(q: Quantiser, blocks: DataFrame, queries: DataFrame, k: int = 3, exclude_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hits, work): (qid, rank, did, distance) of the nearest rows found, and (qid, coded, compared) rows looked at per query."""
    need = k + 1 if exclude_self else k
    rows = whole_vectors(queries, "qid", "qvec").where(F.size("vec") == q.dim)
    cells, dim = Cells(q.centroids), q.dim
    asked = written(vecblocks.assign(rows, cells), "ivf-asked")
    qblocks = written(pack(asked, vecblocks.cut_rings(asked, cells, rings=1)).select(F.monotonically_increasing_id().alias("qb"), "ids", "x"),
                      "ivf-queries")
    kinds = [qblocks.schema["ids"].dataType.elementType, blocks.schema["ids"].dataType.elementType]

    def probe(batches):
        for batch in batches:
            for qb, x in zip(batch.column("qb").to_pylist(), batch.column("x").to_pylist()):
                found = np.flatnonzero(q.probed(np.frombuffer(x).reshape(-1, dim)).any(axis=0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), qb)), pa.array(found.astype(np.int32))], ["qb", "cell"])

    def handed(out):
        vid, block, at, d, n = zip(*out)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(vid), *(pa.array(np.concatenate(v)) for v in (block, at, d, n))],
                                          ["vid", "block", "at", "rough", "coded"])

    def scan(batches):
        for batch in batches:
            out, held = [], 0
            for c, block, ids, x, codes in zip(*(batch.column(n) for n in ("cell", "block", "ids", "x", "codes"))):
                x = np.frombuffer(x.as_py()).reshape(-1, dim)
                own = np.flatnonzero(q.probed(x)[:, c.as_py()])
                codes = np.frombuffer(codes.as_py(), dtype=np.uint8).reshape(-1, len(q.books))
                d = q.distances(x[own] - q.centroids[c.as_py()], codes)
                last = min(need, len(codes)) - 1
                row, at = np.nonzero(d <= (np.partition(d, last, axis=1)[:, last] + q.slack)[:, None])
                out.append((ids.values.take(pa.array(own[row])), np.full(len(row), block.as_py()), at.astype(np.int32), d[row, at],
                            np.where(np.diff(row, prepend=-1) > 0, len(codes), 0)))
                held += len(row)
                if held >= HELD:  # a batch of blocks may give far more rows than it has bytes
                    yield handed(out)
                    out, held = [], 0
            if out:
                yield handed(out)

    pairs = (qblocks.select("qb", "x").mapInArrow(probe, "qb long, cell int").join(blocks.select("cell", "block", "codes"), "cell")
             .join(qblocks, "qb").select("cell", "block", "codes", "ids", "x"))
    schema = T.StructType([T.StructField("vid", kinds[0]), T.StructField("block", T.LongType()), T.StructField("at", T.IntegerType()),
                           T.StructField("rough", T.DoubleType()), T.StructField("coded", T.LongType())])
    rough = pairs.mapInArrow(scan, schema)
    whole = Window.partitionBy("vid").orderBy("rough").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = written(rough.select("*", F.nth_value("rough", need).over(whole).alias("kth"), F.sum("coded").over(whole).alias("all"))
                   .where(F.col("kth").isNull() | (F.col("rough") <= F.col("kth") + F.lit(q.slack))), "ivf-near")

    def rank(batches):
        for batch in batches:
            out = []
            for asks, ids, x in zip(*(batch.column(n) for n in ("asks", "ids", "x"))):
                x, ids = np.frombuffer(x.as_py()).reshape(-1, dim), ids.values
                vids, asked_, places = (asks.values.field(f) for f in ("vid", "qx", "at"))
                row = np.repeat(np.arange(len(vids)), places.value_lengths().to_numpy(zero_copy_only=False))
                col = places.flatten().to_numpy(zero_copy_only=False)
                row, col, d = top_pairs(matrix(asked_, dim), x, row, col, ids.to_numpy(zero_copy_only=False), need)
                out.append((vids.take(pa.array(row)), ids.take(pa.array(col)), d))
            if out:
                vid, did, d = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(vid), pa.concat_arrays(did), pa.array(np.concatenate(d))], ["qid", "did", "distance"])

    # A block's vectors travel once for every few hundred queries that have candidates in it, not once for each.
    listed = (near.groupBy("vid", "block").agg(F.collect_list("at").alias("at"))  # places within one block: at most its rows
              .join(asked.select(F.col("id").alias("vid"), F.col("x").alias("qx")), "vid"))
    chunks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("block")) / ASKS)
    listed = (listed.withColumn("chunk", F.pmod(F.xxhash64("vid"), chunks)).groupBy("block", "chunk")
              .agg(F.collect_list(F.struct("vid", "qx", "at")).alias("asks")).join(blocks.select("block", "ids", "x"), "block"))
    schema = T.StructType([T.StructField("qid", kinds[0]), T.StructField("did", kinds[1]), T.StructField("distance", T.DoubleType())])
    hits = listed.select("asks", "ids", "x").mapInArrow(rank, schema)
    if exclude_self:
        hits = hits.where(~F.equal_null("qid", "did"))
    w = Window.partitionBy("qid").orderBy("distance", "did")
    hits = written(hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "did", "distance"), "ivf-hits")
    work = written(near.groupBy(F.col("vid").alias("qid")).agg(F.max("all").alias("coded"), F.count(F.lit(1)).alias("compared")), "ivf-work")
    drop_scratch(asked, qblocks, near)
    return hits, work
