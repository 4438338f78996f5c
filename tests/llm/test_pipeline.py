"""The pipeline's stages against plain Python on the smallest table, and on awkward rows."""

import corpus_pipeline as cp
from furrow.llm import language
from tests.llm.test_dedup import brute_components, brute_substring


def test_stages_match_brute_force(spark, sf, documents):
    pred = {r.doc_id: r for r in language.identify(documents).collect()}
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    rows = [x for x in rows if pred[x[0]].lang_pred != "und" and pred[x[0]].score >= cp.MIN_LANGUAGE_SHARE]
    one = cp.language_id(spark, documents, sf)
    assert one.columns == documents.columns and sorted(r.doc_id for r in one.collect()) == [d for d, _ in rows]
    keep = {d for d, _, c in brute_components(rows) if d == c}
    rows = [x for x in rows if x[0] in keep]
    two = cp.near_dedup(spark, one, sf)
    assert sorted(r.doc_id for r in two.collect()) == [d for d, _ in rows]
    cut = brute_substring(rows, 50)
    want = {d: (t if not gone else kept) for (d, t), (_, n, gone, kept) in zip(rows, cut) if not gone or gone < n}
    three = cp.substring_dedup(spark, two, sf)
    assert {r.doc_id: r.text for r in three.collect()} == want and three.columns == documents.columns
    items = [r.text.lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {d for d, t in want.items() if any(" ".join(i) in " ".join(t.lower().split()) for i in items)}
    four = {r.doc_id for r in cp.decontaminate(spark, three, sf).collect()}
    assert not four & leaked and len(four) >= len(want) - len(leaked) - 3
    last = cp.run(spark, sf).collect()
    assert {r.doc_id for r in last} == four and all(r.lossless and r.n_pieces == len(r.pieces) for r in last)


def test_awkward_rows(spark, sf, make):
    rows = make([(1, None), (2, ""), (3, "the cat and the dog are there"), (3, "the cat and the dog are there"), (None, "the end of that"),
                 (4, "!!! 123"), (5, "The cat and the dog are there")])
    docs = rows
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted((r.doc_id is None, r.doc_id) for r in docs.collect() if r.doc_id is not None) == [(False, 3)]
    docs = rows.limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
