"""Language, quality, chat, pieces, sharding, HTML, decontamination and LM scoring."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from furrow.llm import chat, decontam, html, language, lm, pieces, quality, sharding
from furrow.llm.queries import QUERIES
from furrow.llm.words import Words

SPACE = " \t\n\x0b\x0c\r"


# language -----------------------------------------------------------------------------------------------------------

def test_language_held_out_accuracy(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op10_language_id"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(got) == len(rows) and all(got[r.doc_id].held_out for r in held)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97


def test_language_edges_and_spans(make):
    de, en = "der hund und die katze schlafen nicht ", "the dog with that thing was there "
    train = make([(i, t * 5, lang) for i, (t, lang) in enumerate([(de, "de"), (en, "en")] * 20)] + [(90, "привет мир как дела " * 9, "ru")])
    m = language.learn(train)
    rows = make([(1, None), (2, "123 !?"), (3, en * 3), (4, de * 20 + en * 4), (5, "мир привет"), (6, ""), (None, en), (3, en * 3)])
    got = {r.doc_id: r for r in language.predict(rows.withColumn("score", F.lit("x")), m).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6, None)] == ["und", "und", "en", "de", "ru", "und", "en"]
    assert got[1].score == 0 and got[4].n_spans == 2 and 0.5 < got[4].score < 1
    assert language.predict(make([]).limit(0), m).count() == 0
    assert [r.lang_pred for r in language.predict(rows, language.learn(train.limit(0))).collect()] == ["und"] * 8


def test_constant_path_shortcut_equals_viterbi():
    r = np.random.default_rng(0)
    for _ in range(50):
        s = r.normal(size=(r.integers(1, 30), 3)) * 4
        best = max(((s[0, a], (a,)) for a in range(3)), key=lambda x: x[0])
        layer = {a: (s[0, a], (a,)) for a in range(3)}
        for t in range(1, len(s)):
            layer = {b: max(((v - (0 if a == b else 5) + s[t, b], p + (b,)) for a, (v, p) in layer.items()), key=lambda x: x[0])
                     for b in range(3)}
        best = max(layer.values(), key=lambda x: x[0])
        path = language.viterbi([s], 5)[0]
        gain = s[np.arange(len(s)), path].sum() - 5 * (np.diff(path) != 0).sum()
        assert gain == pytest.approx(best[0])


# quality ------------------------------------------------------------------------------------------------------------

def test_quality_verdict_does_not_depend_on_the_order(documents, make):
    a = quality.apply_rules(documents).select("doc_id", F.col("rejected_by").isNull().alias("k")).collect()
    b = quality.apply_rules(documents, quality.RULES[::-1]).select("doc_id", F.col("rejected_by").isNull().alias("k")).collect()
    assert sorted(a) == sorted(b)
    assert quality.apply_rules(make([]).limit(0)).count() == 0
    rows = quality.apply_rules(make([(1, None), (2, ""), (None, "a a a a"), (3, "x\nx\n \nx")])).collect()
    assert {(r.doc_id, r.n_words, r.n_dup_lines, r.n_repeat_words) for r in rows} == {(1, 0, 0, 0), (2, 0, 0, 0), (None, 4, 0, 4), (3, 3, 2, 0)}
    assert all(r.base_failed and r.rejected_by for r in rows)


def test_clean_documents_are_kept(spark, sf):
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    out = quality.apply_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(good, "doc_id").where("n_words >= 50")
    r = out.agg(F.avg(F.col("rejected_by").isNull().cast("double"))).first()[0]
    assert r > 0.98


# chat ---------------------------------------------------------------------------------------------------------------

def test_events_fold_and_survive_the_round_trip(spark):
    e = spark.createDataFrame([
        (1, 0, "m1", "message", "user", "hi <b> # \\ there"), (1, 1, "m2", "message", "assistant", "dra"), (1, 2, "m2", "delta", None, "ft"),
        (1, 3, "m2", "regenerate", "assistant", None), (1, 4, "m2", "delta", "assistant", "final </turn>\n### user: x"),
        (1, 5, "m1", "edit", "user", "hello"), (1, 6, "m3", "message", "user", "gone"), (1, 7, "m3", "delete", "user", None),
        (1, 8, "m4", "delta", "a:b", "open"), (1, 9, "m5", "typing", "user", "ignored"), (2, 0, "x", None, None, None),
        (None, 3, "y", "message", "assistant", "\\l\\b"), (2, 1, "d", "message", "u", "same"), (2, 1, "d", "message", "u", "same"),
    ], "conv_id long, seq long, message_id string, kind string, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold_events(e.withColumn("turns", F.lit(0))))).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "hello"), ("assistant", "final </turn>\n### user: x"), ("a:b", "open")]
    assert back[1].loss_text == "final </turn>\n### user: x"
    assert [tuple(t) for t in back[2].turns] == [("", ""), ("u", "same"), ("u", "same")] and back[2].loss_text == ""
    assert [tuple(t) for t in back[None].turns] == [("assistant", "\\l\\b")] and back[None].loss_text == "\\l\\b"
    assert chat.render(chat.fold_events(e.limit(0))).count() == 0


# pieces -------------------------------------------------------------------------------------------------------------

def test_pieces_round_trip_and_reproducible(spark, make, documents):
    v = pieces.load()
    odd = [(1, ""), (2, None), (3, " "), (4, "  x ▁y\n\tz "), (5, "日本語 ✓ ".strip() * 40), (None, "a b"), (6, "x" * 5000), (6, "x" * 5000),
           (7, "\x00​\U0001F600 end")]
    src = make(odd).withColumn("pieces", F.lit("clash")).unionByName(documents.withColumn("pieces", F.lit("clash")))
    coded = pieces.encode(src, v, seed=3)
    rows = pieces.decode(coded, v).collect()
    assert all(r.decoded == r.text for r in rows) and len(rows) == src.count()
    again = {(r.doc_id, r.text): r.pieces for r in pieces.encode(src.repartition(7), v, seed=3).collect()}
    assert all(again[(r.doc_id, r.text)] == r.pieces for r in rows)
    other = {(r.doc_id, r.text): r.pieces for r in pieces.encode(src, v, seed=4).collect()}
    assert any(other[k] != p for k, p in again.items())
    assert pieces.encode(src.limit(0), v).count() == 0


def test_pieces_are_sampled_by_weight():
    v = pieces.load()
    vocabulary = {bytes(v.data[v.offs[i]:v.offs[i + 1]]): int(i) for i in v.ids}

    def all_ways(b):
        if not b:
            yield ()
        for n in range(1, len(b) + 1):
            if b[:n] in vocabulary:
                for rest in all_ways(b[n:]):
                    yield (vocabulary[b[:n]], *rest)

    ways = list(all_ways(b" things"))
    weight = np.array([np.exp(v.weight[list(w)].sum()) for w in ways])
    n = 40_000
    ids, offs = pieces.encode_chunk(v, pa.array(["things"] * n), np.arange(n), 5, 1.0)
    seen = collections.Counter(tuple(ids[offs[i]:offs[i + 1]].tolist()) for i in range(n))
    assert set(seen) <= set(ways)
    for w, p in zip(ways, weight / weight.sum()):
        assert abs(seen[w] / n - p) < 5 * math.sqrt(p / n) + 1e-4


# sharding -----------------------------------------------------------------------------------------------------------

def test_lookup_table_is_balanced_and_moves_little():
    names = [f"s{i}" for i in range(20)]
    t = sharding.lookup_table(names, 2003)
    count = collections.Counter(t)
    assert set(count) == set(range(20)) and max(count.values()) - min(count.values()) <= 1
    u = sharding.lookup_table(names[:-1], 2003)
    moved = sum(a != b for a, b in zip(t, u) if a != 19)
    assert moved < 0.2 * 2003
    w = collections.Counter(sharding.lookup_table(["a", "b"], 1009, [3, 1]))
    assert abs(w[0] - 3 * w[1]) <= 4
    for bad in ((["a"], 10), ([], 11), (["a", "a"], 11)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement_keeps_rows(make, tmp_path):
    rows = make([(1, "a"), (None, "b"), (1, "c"), (2, None)]).withColumn("slot", F.lit("clash"))
    got = sharding.place(rows, ["x", "y"], size=101).collect()
    assert len(got) == 4 and len({r.shard for r in got if r.doc_id == 1}) == 1
    sharding.write_shards(rows, str(tmp_path / "out"), ["x", "y"], size=101, files_per_shard=2)
    assert rows.sparkSession.read.parquet(str(tmp_path / "out")).count() == 4
    assert sharding.place(rows.limit(0), ["x"], size=101).count() == 0


# HTML ---------------------------------------------------------------------------------------------------------------

def test_html_on_unseen_layouts(spark):
    model = html.default_model()
    test = html.labelled_pages(120, seed=321)
    parsed = [html.Page(h) for h in test]
    want = [" ".join(t for node, t in p.runs if p.label[node] == 1) for p in parsed]
    got = html.extract_texts(test, model)
    assert np.mean([a == b for a, b in zip(want, got)]) > 0.85
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<article><p>One &amp; two<br>three <b>fo</b>ur</p><script>x<y</script></article><nav><a>m</a></nav>"),
            (3, "u", "<article><p>a <!-- c --> b"), (None, "u", "plain & < text")]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    assert [(r.page_id, r.text) for r in out][:4] == [(1, ""), (2, ""), (3, "One & two three four"), (3, "a b")]


def test_sum_product_marginals_are_exact():
    pages = [html.Page("<div><p>x y.</p><ul class=menu><li><a>q</a></li></ul></div>")]
    f = html.Forest(pages)
    r = np.random.default_rng(1)
    unary, pair = r.normal(size=html.N_FEATURES), r.normal(size=(html.N_KINDS, 2, 2))
    n, mass, on = len(f.parent), 0.0, np.zeros(len(f.parent))
    for code in range(2**n):
        y = np.array([code >> i & 1 for i in range(n)])
        s = (unary[f.features].sum(1) * y).sum() + sum(pair[f.kind[i], y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0)
        mass += np.exp(s)
        on += np.exp(s) * y
    assert np.allclose(f.marginals(unary, pair)[0], on / mass)


def test_html_of_the_pages_table(spark, sf):
    import html as std
    import re
    src = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op9_html_extract"](spark, sf).collect():
        body = re.search(r"<article>(.*)</article>", src[r.page_id], re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h\d|br|li|ul)>", " ", body))
        assert r.text == " ".join(std.unescape(body).split()) and r.n_chars == len(r.text)


def test_unclosed_elements_end_with_their_parent():
    read = lambda x: " ".join(t for _, t in html.Page(f"<html><body><article>{x}</article></body></html>").runs)
    for name in ("svg", "noscript", "object", "canvas", "audio", "video", "select"):
        assert read(f"<div>one <{name}>gone</div><p>two</p>") == "one two"
    assert read("<p>one</p><style>gone<p>two</p>") == "one"
    assert read("<p>sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> here</p>") == "sum x+1 here"


# decontamination ----------------------------------------------------------------------------------------------------

def test_leaks_and_paraphrases_are_found(spark, make):
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.randrange(15, 60))) for i in range(60)]
    rows, want = [], set()
    for i in range(200):
        body = text(r.randrange(0, 400)).split()
        if i < 60:
            w = items[i][1].split()
            if i % 3 == 1:  # words dropped and replaced
                w = [x if r.random() < 0.85 else r.choice(vocab) for x in w]
                w[-8:] = items[i][1].split()[-8:]
            elif i % 3 == 2:
                w = [x.upper() + "," for x in w]
            at = r.randrange(len(body) + 1)
            body[at:at] = w
            want.add((i, i))
        rows.append((i, " ".join(body)))
    bench = spark.createDataFrame(items + [(99, None), (98, "")], "item_id long, text string")
    out = decontam.find_leaks(make(rows + [(500, None), (501, "")]).withColumn("item_id", F.lit(0)), bench)
    got = {(x.doc_id, x.item_id) for x in out.collect()}
    assert not got - want and len(got & want) >= 0.97 * len(want)
    kept = {x.doc_id for x in decontam.drop_leaks(make(rows), bench).collect()}
    assert kept == set(range(200)) - {d for d, _ in got}
    assert decontam.find_leaks(make(rows), bench.limit(0)).count() == 0
    assert decontam.find_leaks(make([]).limit(0), bench).count() == 0


def test_stop_words_come_from_all_rows(spark, make):
    items = spark.createDataFrame([(1, "common rare alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    rows = [(i, "common filler") for i in range(600)] + [(1000 + i, "other words") for i in range(60_000)]
    b = decontam.fit(make(rows).coalesce(1), decontam.read_benchmark(items))
    word = b.find(decontam.word_hashes(Words(pa.array(["common"]))))[0]
    assert b.df[word] == 600 and b.idf[word] == pytest.approx(math.log(60_601 / 600.5))


def test_no_leak_is_missed_with_many_parts(spark, make):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(vocab[int(400 * r.random() ** 2)] for _ in range(n))
    items = [(i, text(r.choice([1, 2, 5, 9, 16, 30, 64, 90]))) for i in range(300)]
    rows = []
    for i in range(300):
        w = items[i][1].split()
        if i % 2:
            w = [x for k, x in enumerate(w) if k >= len(w) - 8 or r.random() < 0.6]
        rows.append((i, " ".join([text(r.randrange(150)), *w, text(r.randrange(150))])))
    docs = make(rows)
    b = decontam.fit(docs, decontam.read_benchmark(spark.createDataFrame(items, "item_id long, text string")))
    s = decontam._Searcher(b)
    col = pa.array([t for _, t in rows])
    got = set(zip(*[x.tolist() for x in s.find(col)[:2]], strict=True))
    w, ids, block, first = decontam._blocks(b, col)
    want = set()
    for d in range(len(rows)):
        starts = w.word_offs[d] + np.arange(max(1, first[d + 1] - first[d] - 1)) * decontam.BLOCK
        start, part = np.repeat(starts, len(b.parts)), np.tile(np.arange(len(b.parts)), len(starts))
        common, answer = s.verify(w, ids, start, part)
        share = common / s.lengths[part]
        hit = (share >= decontam.FOUND) | ((share >= decontam.PARAPHRASE) & answer)
        want |= {(d, int(b.items[p])) for p in part[hit]}
    assert len(b.parts) > 300 and len(want) > 300 and got == want


def test_bit_parallel_lcs():
    r = random.Random(2)
    for _ in range(60):
        a, b = [[r.randrange(6) for _ in range(r.randrange(1, n))] for n in (64, 128)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in ((i, j) for i in range(len(a)) for j in range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        masks = np.array([[sum(1 << i for i, x in enumerate(a) if x == y)] for y in b], dtype=np.uint64)
        assert decontam.lcs(masks)[0] == table[-1][-1]


# LM -----------------------------------------------------------------------------------------------------------------

def test_lm_base_score_matches_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    toks = {r.doc_id: [x for x in (r.text or "").translate(low).translate(dict.fromkeys(map(ord, SPACE), " ")).split(" ") if x] + [None] for r in rows}
    held = {d for d in toks if zlib.crc32(str(d).encode()) % 7 == 2}
    c = collections.Counter(t for d, ts in toks.items() if d not in held for t in ts)
    n, v = sum(c.values()), len(c)
    better = []
    for r in QUERIES["op6_lm_score"](spark, sf).collect():
        ts = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (r.doc_id in held, len(ts), n)
        assert r.n_known == sum(c[t] > 0 for t in ts)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), rel=1e-9)
        assert r.score < 0
        if r.held_out:
            better.append((r.score, r.base_score))
    assert sum(s for s, _ in better) > sum(b for _, b in better)


def test_lm_filter_never_underestimates(make, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 4)
    rows = [(1, "a b a b a b"), (2, "a c"), (3, None), (None, "a zzz"), (1, "a b")]
    m, counts = lm.train(make(rows[:3]))
    tok, pair, _ = lm.tokens(Words(pa.array(["a b a"])))
    assert m.n_tokens == 11 and m.n_distinct == 4 and m.probe(tok)[0] == 3 and m.probe(pair)[1] == 2
    out = {(r.doc_id, r.n_tokens): r for r in lm.score(make(rows), m, counts).collect()}
    assert out[(None, 3)].n_known == 2 and out[(3, 1)].n_known == 1
    assert out[(1, 3)].base_score == pytest.approx(sum(math.log10((x + 1) / 16) for x in (4, 3, 3)))
    empty, none = lm.train(make([]).limit(0))
    assert lm.score(make(rows), empty, none).where("n_known = 0 and base_score = 0").count() == 5


def test_lm_filter_grows_with_the_ngrams(make):
    r = random.Random(5)
    rows = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(500))) for i in range(40)]
    small, _ = lm.train(make(rows[:4]))
    m, _ = lm.train(make(rows * 2))
    size = lambda x: x.blocks.agg(F.sum(F.octet_length("bits"))).first()[0]
    tok, pair, _ = lm.tokens(Words(pa.array([t for _, t in rows])))
    for h in (tok, pair):
        h, n = np.unique(h, return_counts=True)
        assert (m.probe(h) >= np.floor(np.log2(2 * n)) + 1).all()
    assert size(m) > 4 * size(small) and m.blocks.count() > 1


def test_lm_learns_pairs_seen_once(make):
    m, counts = lm.train(make([(1, "a b c d"), (2, "a c"), (3, "d b")]))
    tok, pair, _ = lm.tokens(Words(pa.array(["a b c d", "a c", "d b"])))
    assert (m.probe(pair) >= 1).all() and (m.probe(tok) >= 1).all()
    seen, unseen = sorted(lm.score(make([(1, "a b c d"), (2, "d c b a")]), m, counts).collect(), key=lambda r: r.doc_id)
    assert seen.base_score == pytest.approx(unseen.base_score) and seen.score > unseen.score


def test_lm_score_by_hand(make, monkeypatch):
    """Scores against a direct reading of the formula, weights of the best deleted likelihood, probabilities that add up to at most one."""
    monkeypatch.setattr(lm, "FIT_SHARE", 1)
    monkeypatch.setattr(lm, "KEY_BITS", 400)  # no false positives
    r = random.Random(8)
    texts = [" ".join(r.choice(["a b", "c d e", "f", "G", "h i"]) for _ in range(r.randint(0, 40))) for _ in range(60)]
    m, counts = lm.train(make(list(enumerate(texts))))
    end = "<end>"
    runs = [[None, *(t.lower().split()), end] for t in texts]
    one, two = {}, {}
    for run in runs:
        for v, w in zip(run, run[1:]):
            one[w] = one.get(w, 0) + 1
            two[v, w] = two.get((v, w), 0) + 1
    n, k = sum(one.values()), len(one)
    assert (m.n_tokens, m.n_distinct, m.n_docs) == (n, k, len(texts))
    before = lambda v: len(texts) if v is None else one.get(v, 0)
    least = lambda x: 2 ** (x.bit_length() - 1) if x else 0

    def p(v, w):
        x = m.mixture[before(v).bit_length()]
        return x * least(two.get((v, w), 0)) / max(before(v), 1) + (1 - x) * (one.get(w, 0) + 1) / (n + k + 1)

    new = ["a b a zz", "", "e c", "zz", "h i h i f g"]
    got = {r.doc_id: r.score for r in lm.score(make(list(enumerate(new))), m, counts).collect()}
    for i, t in enumerate(new):
        run = [None, *t.split(), end]
        assert abs(got[i] - sum(math.log10(p(v, w)) for v, w in zip(run, run[1:]))) < 1e-9
    assert all(sum(p(v, w) for w in one) + (1 - m.mixture[before(v).bit_length()]) / (n + k + 1) <= 1 + 1e-12 for v in [None, *one])

    gains = {}
    for run in runs:
        for v, w in zip(run, run[1:]):
            q, word = max(least(two[v, w]) - 1, 0) / max(before(v) - 1, 1), one[w] / (n + k)
            g = gains.setdefault(before(v).bit_length(), [0, np.zeros(len(lm.WEIGHTS))])
            g[0] += 1
            g[1] += np.log(lm.WEIGHTS * min(q, 1) + (1 - lm.WEIGHTS) * word)
    every = sum(g for _, g in gains.values()) / sum(c for c, _ in gains.values())
    for level, (_, g) in gains.items():
        assert m.mixture[level] == lm.WEIGHTS[np.argmax(g + lm.LEAN * every)]


def test_lm_weights_come_from_every_training_row(make):
    """Three rows of one repeated pair: whichever row is there, its level leans on the pairs."""
    m, _ = lm.train(make([(i, "a b " * 40) for i in (1, 2, 3)]))
    assert m.mixture[lm._level(np.array([120]))[0]] > 0.9
