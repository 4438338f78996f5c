"""Exact and approximate neighbours against brute force."""

import numpy as np
import pytest

from furrow.operators import ivf, retrieval, vecblocks


def frame(spark, rows, names):
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v]) for i, v in rows], names)


def brute(queries, docs, k, exclude_self=False, metric="l2sq"):
    out = {}
    for qid, q in queries:
        found = []
        for did, d in docs:
            if d is None or q is None or (exclude_self and qid == did):
                continue
            q_, d_ = np.array(q, float), np.array(d, float)
            if metric == "cosine":
                found.append((1 - q_ @ d_ / np.linalg.norm(q_) / np.linalg.norm(d_), did))
            else:
                found.append((float(sum((a - b) ** 2 for a, b in zip(q_, d_))), did))
        out[qid] = sorted(found)[:k]
    return out


def clusters(n, dim, centres, seed, spread=0.05):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim)) * 4
    return c[r.integers(0, centres, n)] + r.normal(size=(n, dim)) * spread


def compare(hits, want, ties=False):
    got = {}
    for r in hits.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.distance, r.did, r["rank"]))
    assert {q: len(v) for q, v in want.items() if v} == {q: len(v) for q, v in got.items()}
    for q, v in got.items():
        assert [x[2] for x in v] == list(range(1, len(v) + 1))
        assert np.allclose([x[0] for x in v], [x[0] for x in want[q]], atol=1e-9)
        assert ties or [x[1] for x in v] == [x[1] for x in want[q]]


@pytest.mark.parametrize("exclude_self", [False, True])
def test_knn_on_clusters_copies_and_ties(spark, monkeypatch, exclude_self):
    monkeypatch.setattr(vecblocks, "BLOCK", 16)  # many blocks and rings
    x = clusters(300, 6, 9, 1)
    rows = list(enumerate(x.tolist())) + [(1000 + i, x[0].tolist()) for i in range(150)] + [(2000, None)]
    docs, queries = frame(spark, rows, "did long, dvec array<double>"), frame(spark, rows, "qid long, qvec array<double>")
    compare(retrieval.knn(queries, docs, k=4, exclude_self=exclude_self), brute(rows, rows, 4, exclude_self))


def test_knn_cosine_and_document_columns(spark):
    r = np.random.default_rng(2)
    rows = list(enumerate(r.normal(size=(80, 5)).tolist())) + [(90, [0.0] * 5)]
    docs = spark.createDataFrame([(f"d{i}", v, f"t{i}") for i, v in rows], "did string, dvec array<double>, text string")
    asks = [(i, (np.array(v) * (i + 1)).tolist()) for i, v in rows[:20]] + [(90, [0.0] * 5)]
    got = retrieval.knn(frame(spark, asks, "qid long, qvec array<double>"), docs, k=3, metric="cosine")
    want = brute(asks[:20], [(f"d{i}", v) for i, v in rows[:80]], 3, metric="cosine")
    compare(got.drop("text"), want)
    assert all(x.text == "t" + x.did[1:] for x in got.collect())
    with pytest.raises(ValueError):
        retrieval.knn(frame(spark, asks, "qid long, qvec array<double>"), docs, metric="l1")


def test_knn_small_and_empty_stores(spark):
    q = frame(spark, [(1, [0, 0]), (2, [3, 3]), (3, None)], "qid long, qvec array<double>")
    docs = frame(spark, [(7, [1, 1]), (8, [float("nan"), 0])], "did long, dvec array<double>")
    assert sorted((r.qid, r.did) for r in retrieval.knn(q, docs, k=3).collect()) == [(1, 7), (2, 7)]
    assert retrieval.knn(q, docs.limit(0), k=3).count() == 0
    assert retrieval.knn(q.limit(0), docs, k=3).count() == 0
    assert retrieval.knn(q, docs.where("did = 7"), k=2, exclude_self=True).count() == 2


def test_clustered_queries_open_few_rings():
    x = clusters(6000, 8, 40, 3)
    cells = vecblocks.Cells(x[:77])
    cell, r = cells.nearest(x)
    d = vecblocks.Directory(*(np.array(v) for v in zip(*[(c, 0, (cell == c).sum(), r[cell == c].min(), r[cell == c].max()) for c in np.unique(cell)])))
    low, high = d.bounds(x[:200], cells)
    true = np.sqrt(((x[:200, None] - x[None]) ** 2).sum(axis=2))
    for j, c in enumerate(d.cell):
        assert (low[:, j] <= true[:, cell == c].min(axis=1) + 1e-12).all() and (high[:, j] >= true[:, cell == c].max(axis=1) - 1e-12).all()
    far = np.sort(true, axis=1)[:, 3]
    opened = low <= far[:, None]
    assert (opened * d.n).sum() < 0.1 * 200 * len(x)


def recall(hits, want):
    got = {}
    for r in hits.collect():
        got.setdefault(r.qid, set()).add(r.did)
    return np.mean([d in got.get(q, ()) for q, v in want.items() for _, d in v])


def test_ivf_on_clusters_compares_few_pairs(spark, tmp_path):
    rows = list(enumerate(clusters(4000, 16, 50, 5, 0.3).tolist()))
    ivf.build(frame(spark, rows, "did long, dvec array<double>"), str(tmp_path / "index"))
    q, blocks = ivf.load(spark, str(tmp_path / "index"))
    assert blocks.agg({"n": "sum"}).first()[0] == len(rows) and len(q.centroids) == 63
    asked = rows[::20]
    hits, work = ivf.search(q, blocks, frame(spark, asked, "qid long, qvec array<double>"), k=3, exclude_self=True)
    want = brute(asked, rows, 3, True)
    assert recall(hits, want) >= 0.9
    w = work.collect()
    assert len(w) == len(asked) and sum(r.coded for r in w) < 0.1 * len(asked) * len(rows) and all(r.compared <= r.coded for r in w)
    true = {(q_, d): v for q_, found in want.items() for v, d in found}
    assert all(r.distance == pytest.approx(true[r.qid, r.did], abs=1e-9) for r in hits.collect() if (r.qid, r.did) in true)


def test_ivf_edges(spark, tmp_path):
    docs = frame(spark, [(1, [0, 0, 1]), (2, None), (3, [0, 2, 0]), (4, [float("nan"), 0, 0]), (5, [0, 0, 1])], "did long, dvec array<double>")
    asked = frame(spark, [(1, [0, 0, 1]), (9, None), (8, [1.0])], "qid long, qvec array<double>")
    ivf.build(docs, str(tmp_path / "a"))
    hits, _ = ivf.search(*ivf.load(spark, str(tmp_path / "a")), asked, k=3)
    assert [(r.qid, r.did, r.distance) for r in hits.orderBy("rank").collect()] == [(1, 1, 0.0), (1, 5, 0.0), (1, 3, 5.0)]
    ivf.build(docs.limit(0), str(tmp_path / "b"))
    assert ivf.load(spark, str(tmp_path / "b")) == (None, None)


def test_kmeans_restarts_empty_clusters():
    x = np.repeat([[0.0, 0], [5, 5], [9, 0]], [50, 3, 1], axis=0)
    assert sorted(map(tuple, ivf.kmeans(x, 8, 0).tolist())) == [(0, 0), (5, 5), (9, 0)]


def test_a_part_keeps_k_rows_a_query_whatever_its_blocks():
    """A query block and a store block travel once to a part, and each query leaves it with its nearest rows alone."""
    import pyarrow as pa
    r = np.random.default_rng(8)
    q, d = r.normal(size=(40, 6)), r.normal(size=(96, 6))
    left = pa.table({"qb": [0, 1], "ids": [list(range(20)), list(range(20, 40))], "x": [q[:20].tobytes(), q[20:].tobytes()],
                     "opened": [[1, 2, 3], [2]], "bound": [np.full(20, np.inf).tobytes()] * 2})
    right = pa.table({"code": [1, 2, 2, 3], "ids": [list(range(lo, lo + 24)) for lo in (0, 24, 48, 72)],
                      "x": [d[lo:lo + 24].tobytes() for lo in (0, 24, 48, 72)]})
    got = vecblocks.nearest_pairs(left, right, 6, 3).to_pylist()
    assert len(got) == 40 * 3
    dist = ((q[:, None] - d[None]) ** 2).sum(axis=2)
    dist[20:, :24] = dist[20:, 72:] = np.inf
    want = {i: set(np.argsort(dist[i])[:3]) for i in range(40)}
    assert {i: {g["did"] for g in got if g["vid"] == i} for i in range(40)} == want
    own = vecblocks.nearest_pairs(left, right, 6, 3, other_ids=True).to_pylist()
    assert all(g["vid"] != g["did"] for g in own)


def test_hashed_neighbours_share_a_value_and_list_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(vecblocks, "BLOCK", 16)
    r = np.random.default_rng(9)
    x, h = r.normal(size=(200, 5)), r.integers(0, 4, (200, 2))
    rows = [(i, x[i].tolist(), h[i].tolist()) for i in range(200)]
    got = retrieval.knn_hashed(spark.createDataFrame(rows, "id long, vec array<double>, h array<bigint>"), 2)
    want = {}
    for i in range(200):
        near = [(float(((x[i] - x[j]) ** 2).sum()), j) for j in range(200) if j != i and (h[i] == h[j]).any()]
        want[i] = sorted(near)[:2]
    compare(got, want)


def test_ivf_hands_candidates_on_in_bounded_batches(spark, tmp_path, monkeypatch):
    """However many blocks an Arrow batch holds, a task keeps a bounded number of candidates; the hits are the same."""
    rows = list(enumerate(clusters(600, 8, 6, 11, 0.3).tolist()))
    ivf.build(frame(spark, rows, "did long, dvec array<double>"), str(tmp_path / "index"))
    q, blocks = ivf.load(spark, str(tmp_path / "index"))
    asked = frame(spark, rows[::5], "qid long, qvec array<double>")
    found = []
    for held in (1, 1 << 30):
        monkeypatch.setattr(ivf, "HELD", held)
        hits, work = ivf.search(q, blocks, asked, k=3)
        found.append((sorted(map(tuple, hits.collect())), sorted(map(tuple, work.collect()))))
    assert found[0] == found[1]
