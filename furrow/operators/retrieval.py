"""Exact nearest-neighbour retrieval, relevance gate, sources and context.

``knn`` is exact and compares a query only with the parts of the store that can hold one of its neighbours:

1. About sqrt(N) pivots (fewer for a small store; the rows of lowest seeded hash; N is read off the hashes) split the store into cells, each cell into rings
   by distance from its pivot. The store's (id, vector) is read for the pivots and once more to write it in packed blocks, by ring.
2. Queries with equal vectors are one. They are packed by their own nearest pivot, so the queries of a block open the same rings.
3. A first pass opens each query's home rings and fixes its k-th distance; a second opens only rings whose lower bound
   (triangle inequality) does not exceed it. Both are co-groups of bounded parts of the queries and of the store: a block
   travels once to a part, whatever number of its blocks opens the ring, and a part keeps k rows a query. A matrix product finds
   the candidates of a block pair, and their distances are summed left to right in double.
4. Top-k per query by ``row_number``; document columns are joined to the hits alone and never pass through Python.

On clustered embeddings most rings stay closed; on near-orthogonal random vectors bounds cannot prune and all blocks meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators.vecblocks import (BLOCK, EPS, RINGS, Directory, assign, cut_rings, meet, nearest_pairs, pack, packed, parts_of,
                                        pick_pivots, whole_vectors)
from furrow.session import drop_scratch, written


def _opened(qblocks: DataFrame, choose) -> DataFrame:
    """The query blocks with the codes of the rings they open and a squared distance for each row, beyond which nothing is looked for.

    ``choose(batch, i)`` gives a mask over the directory as codes, and the distances."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                code, bound = choose(batch, i)
                yield pa.RecordBatch.from_arrays([*batch.select(["qb", "ids", "x"]).slice(i, 1).columns, pa.array([code], pa.list_(pa.int64())),
                                                  pa.array([bound.tobytes()], pa.binary())], ["qb", "ids", "x", "opened", "bound"])

    return qblocks.mapInArrow(run, T.StructType([*(qblocks.schema[c] for c in ("qb", "ids", "x")),
                                                 T.StructField("opened", T.ArrayType(T.LongType())), T.StructField("bound", T.BinaryType())]))


def _compare(asks: DataFrame, store: DataFrame, grid: tuple[int, int], dim: int, need: int, **limits) -> DataFrame:
    """(qb, vid, did, distance): each query's nearest rows of each part of the store."""
    kinds = [df.schema["ids"].dataType.elementType for df in (asks, store)]
    schema = T.StructType([T.StructField("qb", T.LongType()), T.StructField("vid", kinds[0]), T.StructField("did", kinds[1]),
                           T.StructField("distance", T.DoubleType())])
    return meet(asks, store, grid, lambda left, right: nearest_pairs(left, right, dim, need, **limits), schema)


def _best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("vid").orderBy("distance", "did")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest(queries: DataFrame, rows: DataFrame, need: int, seed: int, n_pivots: int | None) -> DataFrame | None:
    """(vid, did, distance, rank) of the `need` nearest rows of each query vector; None for an empty store."""
    cells = pick_pivots(rows, seed, n_pivots)
    if cells is None:
        return None
    assigned = written(assign(rows, cells), "knn-rows")
    cells = cut_rings(assigned, cells)
    blocks = written(pack(assigned, cells), "knn-blocks")
    directory = Directory.of(blocks)
    asked = written(assign(queries, cells), "knn-asked")
    sizes = cut_rings(asked, cells, rings=1)  # queries are packed by cell alone
    qblocks = written(pack(asked, sizes).select(F.monotonically_increasing_id().alias("qb"), "ids", "x"), "knn-queries")
    dim = cells.dim

    store = blocks.select((F.col("cell").cast("long") * RINGS + F.col("ring")).alias("code"), F.monotonically_increasing_id().alias("block"),
                          "ids", "x")
    grid = parts_of(qblocks, 8 * dim), parts_of(blocks, 8 * dim)
    code = directory.cell.astype(np.int64) * RINGS + directory.ring

    def home(batch, i):
        x = np.frombuffer(batch.column("x")[i].as_py()).reshape(-1, dim)
        mask = np.zeros(len(directory.n), dtype=bool)
        for lo in range(0, len(x), 64):
            mask |= directory.home(x[lo:lo + 64], cells, need).any(axis=0)
        return x, mask

    def first(batch, i):
        x, mask = home(batch, i)
        return code[mask], np.full(len(x), np.inf)

    def second(batch, i):
        x, opened = home(batch, i)
        known = dict(zip(batch.column("vids")[i].as_py(), batch.column("far")[i].as_py()))
        bound = np.array([known.get(v, np.inf) for v in batch.column("ids")[i].as_py()])
        far = np.sqrt(bound)
        mask = np.zeros(len(directory.n), dtype=bool)
        for lo in range(0, len(x), 64):
            mask |= (directory.bounds(x[lo:lo + 64], cells)[0] <= far[lo:lo + 64, None] * (1 + EPS)).any(axis=0)
        mask &= ~opened
        return code[mask], bound

    near = written(_compare(_opened(qblocks, first), store, grid, dim, need), "knn-near")
    far = (_best(near, need).groupBy("qb", "vid").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n")).where(F.col("n") == need)
           .groupBy("qb").agg(F.collect_list("vid").alias("vids"), F.collect_list("far").alias("far")))  # at most a block's queries
    empty = qblocks.schema["ids"].dataType
    known = qblocks.join(far, "qb", "left").select("qb", "ids", "x", F.coalesce("vids", F.array().cast(empty)).alias("vids"),
                                                   F.coalesce("far", F.array().cast("array<double>")).alias("far"))
    asks = written(_opened(known, second), "knn-asks")
    more = _compare(asks, store, grid, dim, need)
    out = written(_best(near.unionByName(more).drop("qb"), need), "knn-hits")
    drop_scratch(assigned, blocks, asked, qblocks, near, asks)
    return out


def knn(queries: DataFrame, docs: DataFrame, k: int = 3, exclude_self: bool = False, n_pivots: int | None = None, seed: int = 7,
        metric: str = "l2sq", share_equal: bool = True) -> DataFrame:
    """Exact top-k.

    queries: (qid, qvec ARRAY<DOUBLE>); docs: (did, dvec ARRAY<DOUBLE>, ...). Output: (qid, rank, did, distance, <doc columns>).
    ``metric``: ``l2sq`` (squared L2) or ``cosine`` (1 - cos; zero vectors have no distance). With ``exclude_self`` a document never
    matches the query of the same id. With ``share_equal`` equal query vectors are searched once. Rows without a finite vector of
    the store's length have no distance and no neighbours.
    """
    if metric not in ("l2sq", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    unit = metric == "cosine"
    rows = whole_vectors(docs, "did", "dvec", unit)
    asked = whole_vectors(queries, "qid", "qvec", unit)
    need = k + 1 if exclude_self else k
    distinct = asked.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec") if share_equal else asked
    if share_equal:
        distinct = written(distinct, "knn-distinct")
    hits = _nearest(distinct, rows, need, seed, n_pivots)
    extra = [c for c in docs.columns if c not in ("did", "dvec")]
    if hits is None:
        kind = T.StructType([queries.schema["qid"], T.StructField("rank", T.IntegerType()), docs.schema["did"], T.StructField("distance", T.DoubleType()),
                             *[docs.schema[c] for c in extra]])
        return queries.sparkSession.createDataFrame([], kind)
    if share_equal:
        hits = asked.withColumnRenamed("id", "qid").join(distinct.select("vec", F.col("id").alias("vid")), "vec").drop("vec").join(hits, "vid")
    hits = hits.withColumnRenamed("vid", "qid") if not share_equal else hits.drop("vid")
    if exclude_self:  # at most one of the k + 1 is the query itself
        gone = F.max(F.when(F.col("qid") == F.col("did"), F.col("rank"))).over(Window.partitionBy("qid"))
        hits = (hits.withColumn("_self", gone).where(~F.equal_null(F.col("rank"), F.col("_self")))
                .withColumn("rank", F.col("rank") - F.when(F.col("rank") > F.col("_self"), 1).otherwise(0)).where(F.col("rank") <= k))
    if unit:
        hits = hits.withColumn("distance", F.col("distance") / 2)
    hits = hits.select("qid", "rank", "did", "distance")
    return hits.join(docs.select("did", *extra), "did", "left").select("qid", "rank", "did", "distance", *extra) if extra else hits


def knn_hashed(rows: DataFrame, k: int = 1) -> DataFrame:
    """(qid, rank, did, distance): of (id, vec, h ARRAY<BIGINT>) rows, each row's k nearest rows of other ids that share a value of h
    at the same place; vectors are finite and of one length, distances squared L2.

    Rows of equal h are packed into blocks. Blocks that share a value meet by an equi-join of the distinct h on (place, value), so a
    pair of rows is compared once however many values it shares, and no pairs of rows are listed.
    """
    shape = rows.select(F.size("vec").alias("dim")).first()
    if shape is None:
        return rows.select(F.col("id").alias("qid"), F.lit(0).alias("rank"), F.col("id").alias("did"), F.lit(0.0).alias("distance"))
    kinds = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).select(
        "h", F.monotonically_increasing_id().alias("cell"), F.ceil(F.col("n") / (8 * BLOCK)).alias("parts")), "lsh-kinds")
    dealt = rows.join(kinds, "h").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).select("id", "vec", "cell", "part")
    schema = T.StructType([dealt.schema["id"], T.StructField("x", T.BinaryType()), dealt.schema["cell"], dealt.schema["part"]])

    def flat(batches):
        for batch in batches:
            x = [np.asarray(v, dtype=np.float64).tobytes() for v in batch.column("vec").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(x, pa.binary()), batch.column("cell"), batch.column("part")], schema.names)

    blocks = written(packed(dealt.mapInArrow(flat, schema).select("id", "x", "cell", F.lit(0.0).alias("r"), F.lit(0).alias("ring"), "part"))
                     .withColumn("qb", F.monotonically_increasing_id()), "lsh-blocks")
    value = kinds.select("cell", F.posexplode("h").alias("place", "value"))
    opened = (value.join(value.withColumnRenamed("cell", "other"), ["place", "value"]).select("cell", "other").distinct()
              .groupBy("cell").agg(F.collect_list("other").alias("opened")))

    def unbounded(batches):
        for batch in batches:
            bound = [np.full(n, np.inf).tobytes() for n in batch.column("n").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound, pa.binary())], [*batch.schema.names, "bound"])

    asks = blocks.join(opened, "cell").select("qb", "ids", "x", "opened", "n")
    asks = asks.mapInArrow(unbounded, T.StructType([*asks.schema.fields, T.StructField("bound", T.BinaryType())]))
    store = blocks.select(F.col("cell").alias("code"), F.col("qb").alias("block"), "ids", "x")
    width = 8 * shape.dim
    hits = _compare(asks, store, (parts_of(blocks, width),) * 2, shape.dim, k, other_ids=True)
    out = written(_best(hits, k).select(F.col("vid").alias("qid"), "rank", "did", "distance"), "lsh-hits")
    drop_scratch(kinds, blocks)
    return out


def gate(hits: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """Per query: best distance, use_rag (best < threshold) and mode; no hit -> 999, general."""
    best = hits.groupBy("qid").agg(F.min("distance").alias("best"))
    j = queries.select("qid").join(best, "qid", "left")
    use = F.coalesce(F.col("best") < threshold, F.lit(False))
    return j.select("qid", use.alias("use_rag"), F.when(use, F.lit("rag")).otherwise(F.lit("general")).alias("mode"),
                    F.round(F.coalesce(F.col("best"), F.lit(999.0)), 4).alias("best_distance"))


def sources(hits: DataFrame, threshold: float) -> DataFrame:
    """Hits under the threshold, numbered by their unfiltered rank; topic/category default ''."""
    s = hits.filter(F.col("distance") < threshold)
    return s.select("qid", F.col("rank").alias("number"), F.col("did").alias("id"),
                    F.coalesce(F.col("topic"), F.lit("")).alias("topic"),
                    F.coalesce(F.col("category"), F.lit("")).alias("category"),
                    F.round("distance", 4).alias("distance"))


def context(hits: DataFrame, threshold: float) -> DataFrame:
    """'[Source i — topic]\\ntext' blocks under the threshold, blank-line joined in rank order.

    At most k hits per query are gathered, so the list is bounded by k.
    """
    s = hits.filter(F.col("distance") < threshold)
    block = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(" — "),
                     F.coalesce(F.col("topic"), F.col("did").cast("string")), F.lit("]\n"), F.col("text"))
    g = s.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("_l"))
    return g.select("qid", F.array_join(F.transform("_l", lambda x: x["b"]), "\n\n").alias("context"))
