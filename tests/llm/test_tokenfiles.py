"""Token files against plain arrays and the tokenizer itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from furrow.llm import tokenfiles
from furrow.llm.queries import END_ID, QUERIES, TOKENIZER
from furrow.session import scratch_path

PATH = public_tokenizers.path(TOKENIZER)


def shard(ids):
    ids = np.array(ids, dtype=np.uint32)
    return tokenfiles.Shard(tokenfiles.shard_bytes(ids, pa.array([7], pa.int64()), np.array([len(ids)])))


def agree(ids, s):
    ids = np.array(ids, dtype=np.uint32)
    n = len(ids)
    assert s.tokens().tolist() == ids.tolist() == s.slice(0, n).tolist()
    r = random.Random(n)
    for t in {*ids.tolist()[:30], *(int(ids[r.randrange(n)]) for _ in range(20) if n), 4_000_000_000, 0}:
        want = np.flatnonzero(ids == t)
        assert s.count(t) == len(want) and s.positions(t).tolist() == want.tolist()
        a, b = sorted((r.randint(0, n), r.randint(0, n)))
        assert s.count(t, a, b) == (ids[a:b] == t).sum()
        for k in {0, len(want) - 1, len(want) // 2}:
            if 0 <= k < len(want):
                assert s.locate(t, k) == want[k] and s.token(int(want[k])) == t
        with pytest.raises(IndexError):
            s.locate(t, len(want))


@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 2 ** 32 - 1)), max_size=300))
@settings(max_examples=60, deadline=None)
def test_any_sequence(ids):
    agree(ids, shard(ids))


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1023, 1024, 1025, 5000])
def test_block_ends_and_skewed_alphabets(n):
    r = np.random.default_rng(n)
    agree([3] * n, shard([3] * n))
    zipf = np.minimum(r.zipf(1.3, n), 60_000)
    agree(zipf, shard(zipf))
    doubling = np.repeat(np.arange(20), [max(1, n >> (k + 1)) for k in range(20)])  # a code as deep as it gets
    agree(doubling, shard(doubling))


def test_a_file_is_near_its_entropy():
    ids = np.minimum(np.random.default_rng(1).zipf(1.2, 500_000), 5_000).astype(np.uint32)
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    assert len(tokenfiles.shard_bytes(ids, pa.array([1], pa.int64()), np.array([len(ids)]))) < 1.15 * len(ids) * -(p * np.log2(p)).sum() / 8


TEXTS = [None, "", " ", "\n\n  a", "it's  we'll\t\tgo \n", "x  y 　 z ", "a<|endoftext|> b", "naïve — 12,5 €\r\n日本 語。", "a" * 3000,
         "\x1c \x85q", " trailing  ", "1 2  3   4", "'s 's", "tab\t word \t two", "é \U0001f600 \U0001f600", "word " * 3000]


def plain(tool, text):
    return [*tool.encode(text or "", add_special_tokens=False).ids, END_ID]


@given(st.lists(st.text(st.sampled_from(" \n\t  a'sll1é.,<|endoftext|>\x1f\x85​"), max_size=25), max_size=6))
@settings(max_examples=150, deadline=None)
def test_units_encode_as_whole_texts(texts):
    e = tokenfiles._encoder(PATH, END_ID)
    ids, n = e.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])][:len(texts)] == [plain(e.tool, t) for t in texts]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    e, tool = tokenfiles.Encoder(path, 0), Tokenizer.from_file(path)
    ids, n = e.encode(pa.array(["The  Cat's hat", None, "a b"]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [
        [*tool.encode(t, add_special_tokens=False).ids, 0] for t in ("The  Cat's hat", "", "a b")]


def expect(rows):
    """{doc_id: [(start, n, crc)]} by the tokenizer alone; rows in file order."""
    tool, at, out = Tokenizer.from_file(PATH), 0, []
    for i, text in rows:
        ids = plain(tool, text)
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_query_equals_brute_force(spark, sf, documents):
    got = sorted(tuple(r) for r in QUERIES["op12_token_files"](spark, sf).collect())
    assert got == expect(sorted((r.doc_id, r.text) for r in documents.collect()))


def test_edge_rows_and_small_shards(spark, make, monkeypatch):
    monkeypatch.setattr(tokenfiles, "RANGE_BYTES", 4000)
    monkeypatch.setattr(tokenfiles, "CHUNK", 1000)
    from pyspark.sql import functions as F
    rows = [(100 - i, t) for i, t in enumerate(TEXTS)]
    docs = make(rows).withColumn("part", F.lit(1)).withColumn("path", F.lit("x"))
    index = tokenfiles.write_tokens(docs, scratch_path(spark, "t"), PATH, END_ID, shard_tokens=50)
    got = sorted(tuple(r) for r in tokenfiles.read_documents(index).collect())
    assert got == sorted(expect(sorted(rows))) and index.count() > 5
    assert [r.start for r in index.orderBy("start").collect()] == np.cumsum([0] + [r.n_tokens for r in index.orderBy("start").collect()])[:-1].tolist()
    tool = Tokenizer.from_file(PATH)
    word = tool.encode(" word").ids[0]
    all_ids = [(i, p, t) for i, text in sorted(rows) for p, t in enumerate(plain(tool, text))]
    want = sorted((i, at, p) for at, (i, p, t) in enumerate(all_ids) if t == word)
    assert sorted(tuple(r) for r in tokenfiles.find_token(index, word).collect()) == want
    assert {r.token: r.n for r in tokenfiles.token_counts(index, [word, END_ID, 99_999]).collect()} == {word: len(want), END_ID: len(rows), 99_999: 0}


def test_null_and_repeated_ids_and_empty_tables(spark, make):
    rows = [(None, "n"), (None, None), (4, "a b"), (4, "a b"), (4, "c"), (-3, "minus")]
    index = tokenfiles.write_tokens(make(rows), scratch_path(spark, "t"), PATH, END_ID)
    got = tokenfiles.read_documents(index).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -3, 4, 4, 4]
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted(x[2:] for x in expect(rows))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    index = tokenfiles.write_tokens(make([]).limit(0), scratch_path(spark, "t"), PATH, END_ID)
    assert index.count() == 0 and tokenfiles.read_documents(index).count() == 0
