"""Near-copy groups with SetSketch registers.

1. *Sketch.* A document is the set of its distinct word shingles. Every shingle emits points of its own Poisson process over
   ``M`` registers, so a register's minimum over a set is exponential with the set's size; registers hold
   ``floor(1 - log_B(minimum))``, truncated to 16 bits. They are mergeable (maximum) and two registers agree with probability
   close to the Jaccard similarity. Documents with equal sets (by a 128-bit set hash) become one node, their smallest doc_id.
2. *Band.* ``BANDS`` bands of ``ROWS`` registers are hashed; nodes sharing a band key are candidates. At a similarity of 0.8 a
   pair misses all bands with probability (1 - 0.8**4)**32, about 5e-8.
3. *Group.* Bands link their members to the smallest one (a star, never all pairs); the stars' components are the candidate
   groups, and only their texts are read again.
4. *Estimate and verify.* Within a group every pair is estimated from its registers by joint maximum likelihood (counts of
   greater, smaller and equal registers, set sizes known); pairs that could reach the threshold are confirmed on full sets.

A group of more than ``BLOCK`` nodes is dealt into blocks. Every block is compared with itself and with the first block by a
task of its own. Members that the result leaves outside the group's largest component (``minority``) are then compared with
all blocks; pairs within that component need no check, since a link there cannot change a component. So a hot group costs tasks
of at most 2 * BLOCK nodes, and work of its minority times its size instead of its size squared.

Output: every row with its set size and the smallest doc_id of its component. Defined edge cases: a null or word-free text has
size 0 and is linked with nothing; a null doc_id is linked with nothing and has a null component; of rows that share a doc_id
each goes with its own set; A-Z are lower-cased; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.components import connected_components
from furrow.llm.words import Words, as_long, chunks, list_array, lists, mix, window_hashes, window_inside
from furrow.session import scratch_path

M = 128
ROWS = 4
BANDS = M // ROWS
B = 1.001
OFFSET = 8192
BLOCK = 1024
#: Pairs estimated this far below the threshold are not verified (over five standard errors at 0.8).
SLACK = 0.2


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all documents one after the other, offsets by document)."""
    h, n = w.hashes(), len(w)
    ok = window_inside(w.counts, w.word_offs, n, size)
    at = np.flatnonzero(ok)
    values, owner = window_hashes(h, size)[at], w.doc[at]
    for k in range(1, size):  # shorter texts: the whole sequence
        docs = np.flatnonzero(w.counts == k)
        if len(docs):
            values = np.concatenate([values, window_hashes(h, k)[w.word_offs[docs]]])
            owner = np.concatenate([owner, docs])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(w.n_docs + 1))


def sketches(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Registers (documents x M, uint16) of shingle sets; zero for empty sets."""
    n_docs = len(offs) - 1
    low = np.full(n_docs * M, np.inf)
    low[(np.flatnonzero(np.diff(offs) == 0)[:, None] * M + np.arange(M)).ravel()] = 0.0
    owner = np.repeat(np.arange(n_docs), np.diff(offs))
    value, t = values, np.zeros(len(values))
    step = 0
    while len(value):
        step += 1
        x = mix(value ^ np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
        t = t - np.log(((x >> np.uint64(12)) + np.uint64(1)) * 2.0**-52) / M
        np.minimum.at(low, owner * M + (x & np.uint64(M - 1)).astype(np.int64), t)
        top = low.reshape(n_docs, M).max(1)
        more = t < top[owner]
        value, t, owner = value[more], t[more], owner[more]
    low = low.reshape(n_docs, M)
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(low) / np.log(B)) + OFFSET
    regs = np.clip(k, 1, 65535)
    regs[np.diff(offs) == 0] = 0
    return regs.astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(documents x BANDS) 64-bit keys."""
    packed = np.ascontiguousarray(regs).reshape(len(regs), BANDS, ROWS).view(np.uint64)[:, :, 0]
    return mix(packed + np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15 >> 8 << 8 | 1))


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.maximum(x, 1e-12) * (B - 1) / B) / np.log(B)


def joint_similarity(greater: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from register comparisons and set sizes (golden-section search)."""
    equal = M - greater - smaller
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)

    def value(j):
        p, q = _p(u - v * j), _p(v - u * j)
        return greater * np.log(p) + smaller * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    ratio = (5**0.5 - 1) / 2
    for _ in range(24):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        up = value(a) < value(b)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    return (lo + hi) / 2


def _sets(size: int):
    """Per row: its set as (doc_id, n, sum hashes, band keys)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, "text"):
                values, offs = shingle_sets(Words(c.column("text"), lower=True), size)
                keys = as_long(band_keys(sketches(values, offs)))
                sums = []
                for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(k)))])
                    sums.append(as_long(total[offs[1:]] - total[offs[:-1]]))
                yield pa.RecordBatch.from_arrays(
                    [c.column("doc_id"), pa.array(np.diff(offs), pa.int64()), pa.array(sums[0]), pa.array(sums[1]),
                     list_array(keys.ravel(), np.arange(c.num_rows + 1) * BANDS, pa.int64())],
                    names=["doc_id", "n", "s1", "s2", "bands"])
    return run


def _members(size: int):
    """Per candidate row: registers and full set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, "text"):
                values, offs = shingle_sets(Words(c.column("text"), lower=True), size)
                regs = sketches(values, offs)
                yield pa.RecordBatch.from_arrays(
                    [c.column(x) for x in ("id", "grp", "blocks")]
                    + [pa.array([r.tobytes() for r in regs], pa.binary()), list_array(as_long(values), offs, pa.int64())],
                    names=["id", "grp", "blocks", "regs", "set"])
    return run


_MEMBER = "id long, grp long, blocks int, regs binary, set array<long>"


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys; the rows arrive sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for x in cols:
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(x[lo] for x in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _links(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest linked id) pairs of one group of members, from links confirmed on full sets.

    Rows with `query` false are compared with query rows only; equal labels count as linked already."""
    ids = t.column("id").to_numpy()
    query = t.column("query").to_numpy(zero_copy_only=False).astype(bool)
    given = t.column("label").to_numpy()
    regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(len(ids), M)
    values, offs = lists(t.column("set"))
    size = np.diff(offs)
    _, dense = np.unique(values, return_inverse=True)
    _, comp = np.unique(given, return_inverse=True)
    comp = comp.astype(np.int64)
    flag = np.zeros(int(dense.max()) + 1 if len(dense) else 1, dtype=bool)
    order = np.flatnonzero(query)
    limit = percent / 100
    for i in order:
        other = np.flatnonzero((comp != comp[i]) & (np.minimum(size, size[i]) * 100 >= percent * np.maximum(size, size[i])))
        if not len(other):
            continue
        big, small = (regs[other] > regs[i]).sum(1), (regs[other] < regs[i]).sum(1)
        near = M - big - small >= (limit - 2 * SLACK) * M
        other, big, small = other[near], big[near], small[near]
        if not len(other):
            continue
        close = joint_similarity(big, small, size[other].astype(float), np.full(len(other), float(size[i]))) >= limit - SLACK
        other = other[close]
        if not len(other):
            continue
        mine = dense[offs[i]:offs[i + 1]]
        flag[mine] = True
        if len(other) > 8:
            total = np.concatenate([[0], np.cumsum(flag[dense])])
            both = (total[offs[1:]] - total[offs[:-1]])[other]
        else:
            both = np.array([np.count_nonzero(flag[dense[offs[j]:offs[j + 1]]]) for j in other])
        flag[mine] = False
        hit = other[100 * both >= percent * (size[other] + size[i] - both)]
        if len(hit):
            comp[np.isin(comp, comp[hit])] = comp[i]
    low = np.full(int(comp.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, comp, ids)
    return ids, low[comp]


def _confirm(keys: list[str], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, keys):
            ids, low = _links(t, percent)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(low, pa.int64()), t.column("grp").combine_chunks(),
                                              t.column("blocks").combine_chunks()], names=["id", "low", "grp", "blocks"])
    return run


_LINK = "id long, low long, grp long, blocks int"


def _bucket(col: str, salt: int, n):
    return F.pmod(F.xxhash64(F.col(col), F.lit(salt)), n).cast("int")


def near_copies(docs: DataFrame, shingle: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; documents are linked if 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    path = scratch_path(spark, "sketch")
    base.mapInArrow(_sets(shingle), "doc_id long, n long, s1 long, s2 long, bands array<long>").write.parquet(path)
    rows = spark.read.schema("doc_id long, n long, s1 long, s2 long, bands array<long>").parquet(path)
    named = rows.where("doc_id is not null and n > 0")

    # One node per distinct set.
    node = named.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"))
    banded = (named.join(node.withColumnRenamed("id", "doc_id"), ["s1", "s2", "doc_id"])
              .select(F.col("doc_id").alias("id"), F.explode("bands").alias("key")))
    hub = banded.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key", "lo")
    stars = banded.join(hub, "key").where("id > lo").select("id", "lo").distinct()
    grp = connected_components(stars, "id", "lo").withColumnRenamed("component", "grp")
    size = grp.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    grp_path = scratch_path(spark, "groups")
    grp.join(size, "grp").select("id", "grp", "blocks").write.parquet(grp_path)
    member = spark.read.schema("id long, grp long, blocks int").parquet(grp_path)

    # Candidates grow with the corpus, so they are never broadcast: texts are dealt by id at every size, once.
    set_path = scratch_path(spark, "sets")
    (base.join(member.hint("merge"), base.doc_id == member.id).select("id", "grp", "blocks", "text")
     .mapInArrow(_members(shingle), _MEMBER).write.parquet(set_path))
    sets = spark.read.schema(_MEMBER).parquet(set_path)

    # Every block with itself and with the first block.
    dealt = (sets.withColumn("label", F.col("id")).withColumn("blk", _bucket("id", 1, F.col("blocks")))
             .withColumn("task", F.explode(F.when(F.col("blk") == 0, F.sequence(F.lit(0), F.col("blocks") - 1))
                                           .otherwise(F.array("blk"))))
             .withColumn("query", F.lit(True)).drop("blk"))
    link_path = scratch_path(spark, "links")
    (dealt.repartition("grp", "task").sortWithinPartitions("grp", "task")
     .mapInArrow(_confirm(["grp", "task"], percent), _LINK).where("id <> low or blocks > 1").write.parquet(link_path))
    links = spark.read.schema(_LINK).parquet(link_path)

    # Groups of several blocks: members outside the largest component against all blocks.
    big = links.where("blocks > 1")
    if big.isEmpty():
        component = links.select("id", F.col("low").alias("component"))
    else:
        joined = connected_components(big, "id", "low").withColumnRenamed("component", "label")
        label = (member.where("blocks > 1").join(joined, "id", "left")
                 .select("id", "grp", "blocks", F.coalesce("label", "id").alias("label"))).checkpoint(eager=True)
        count = label.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("k"))
        main = count.groupBy("grp").agg(F.max(F.struct("k", (-F.col("label")).alias("neg"))).alias("m"), F.sum("k").alias("n"))
        main = main.select("grp", (-F.col("m.neg")).alias("main"), F.ceil((F.col("n") - F.col("m.k")) / BLOCK).cast("int").alias("parts"))
        asked = (sets.where("blocks > 1").join(label.select("id", "label"), "id").join(main.where("parts > 0"), "grp")
                 .withColumn("query", F.col("label") != F.col("main")))
        rest = _tasks(asked)
        more = (rest.repartition("grp", "part", "blk").sortWithinPartitions("grp", "part", "blk")
                .mapInArrow(_confirm(["grp", "part", "blk"], percent), _LINK).where("id <> low").select("id", "low"))
        found = connected_components(big.select("id", "low").unionByName(label.select("id", F.col("label").alias("low")))
                                     .unionByName(more), "id", "low")
        component = links.where("blocks = 1").select("id", F.col("low").alias("component")).unionByName(found)

    component = component.where("id <> component")
    return (rows.join(node, ["s1", "s2"], "left").join(component, "id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id"))
                    .otherwise(F.coalesce("component", "id")).alias("component_id")))


def _tasks(sets: DataFrame) -> DataFrame:
    """Query rows meet every block of their group as queries; every row meets every part of the queries as a partner."""
    s = (sets.withColumn("own_blk", _bucket("id", 1, F.col("blocks"))).withColumn("own_part", _bucket("id", 2, F.col("parts")))
         .withColumnRenamed("query", "asks"))
    as_query = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(
        F.col("own_part").alias("part"), b.alias("blk"), F.lit(True).alias("query")))
    as_partner = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(
        p.alias("part"), F.col("own_blk").alias("blk"), F.lit(False).alias("query")))
    return s.select("id", "grp", "blocks", "label", "regs", "set",
                    F.inline(F.when(F.col("asks"), F.concat(as_query, as_partner)).otherwise(as_partner)))
