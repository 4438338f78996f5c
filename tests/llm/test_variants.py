"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

from pyspark.sql import functions as F

from furrow.llm import variants
from furrow.llm.queries import QUERIES, misspelt


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words, ratio):
    mates = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, m in mates.items():
        best = min(m, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(mates[w]), words.get(form[w])))
    return out


def check(spark, words, ratio=10):
    rows = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("form", F.lit("clash"))
    got = variants.group(rows, ratio)
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute(words, ratio)


def test_groups_equal_brute_force(spark):
    r = random.Random(3)
    words = {"": 4, "a": 50, "aa": 7, "aab": 900, "ab": 900, "éa": 900, "ÿ": 3}
    while len(words) < 300:
        words["".join(r.choice("abé") for _ in range(r.randint(1, 7)))] = r.choice([1, 1, 2, 10, 20, 20, 100, 2000])
    check(spark, words)
    check(spark, words, 2)


def test_long_words_keep_their_order_and_neighbours(spark):
    r = random.Random(5)
    base = "".join(r.choice("xyz") for _ in range(70))
    words = {}
    for size in (63, 64, 65, 66, 67, 70):
        w = base[:size]
        words[w] = 100
        for _ in range(12):
            i = r.randrange(size)
            words[r.choice([w[:i] + w[i + 1:], w[:i] + r.choice("xyz") + w[i + 1:], w[:i] + r.choice("xyz") + w[i:]])] = r.choice([1, 100, 1000])
    long = "ab" * 3000
    words |= {long: 5, long + "a": 50, "b" + long: 50, long[:4000] + "c" + long[4001:]: 50}
    check(spark, words)


def test_chains_are_followed_to_the_root(spark):
    word, words = "m" * 9, {}
    for k in range(8):
        words[word] = 10 ** k
        word = word[:k] + "n" + word[k + 1:]
    check(spark, words)


def test_counts_and_edge_rows(spark, make):
    docs = make([(1, "Größere größere GRöSSERE abcdef"), (2, None), (None, "größere größere"), (3, ""), (3, "größere"), (3, "größere"),
                 (4, "ab" * 40_000 + " " + "ab" * 40_000), (5, "1234567 ------- ×÷×÷×÷×")]).withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    rows = variants.runs(docs, 7)
    got = {r.word: r.n for r in variants.count_words(rows, misspelt(F.col("doc_id"), F.col("run")), 7, 1).collect()}
    want = collections.Counter()
    for d in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", d.text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if d.doc_id is None else d.doc_id}:{low}".encode())
            want[low if h % 31 else low[:h % len(low)] + low[h % len(low) + 1:]] += 1
    assert got == {w: n for w, n in want.items() if len(w) >= 7}
    assert variants.group(variants.count_words(variants.runs(make([]).limit(0), 7), F.col("run"), 7, 2)).count() == 0


def test_query_finds_misspelt_words(spark, sf):
    got = QUERIES["op11_spelling_variants"](spark, sf)
    assert got.where("n_near > 0").count() > 10 and got.where("form is not null").count() > 0
    assert got.where("form is not null and form_n < 10 * n").isEmpty()
