"""Substring dedup and near copies against brute force, with the edge cases of their docstrings."""

import itertools
import random
import re

from pyspark.sql import functions as F

from furrow.llm import nearcopies, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed):
    r = random.Random(seed)
    return " ".join("w%d" % r.randrange(5000) for _ in range(n))


def brute_substring(rows, k):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - k + 1):
            key = tuple(w[i:i + k])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i:i + k])] < d:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def key(rows):
    return sorted(rows, key=repr)


def test_substring_matches_brute_force(make):
    a, b = words(120, 1), words(70, 2)
    rows = [(1, a), (2, words(30, 3) + "\n" + b + "  " + words(5, 4)), (3, b), (4, a), (5, None), (6, ""), (7, "short text"),
            (None, a), (8, words(49, 3)), (9, " ".join(a.split()[20:90]) + " x " + b), (9, b), (4, a), (10, "z " * 300), (11, "z " * 80),
            (12, "Ünï\x1fcode kept " * 30), (13, "Ünï\x1fcode kept " * 30)]
    out = substring.remove_repeats(make(rows).withColumn("key", F.lit("clash")).withColumn("h", F.lit(1)), 50)
    assert key(tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept").collect()) == key(brute_substring(rows, 50))


def test_substring_empty_and_carry(make):
    assert substring.remove_repeats(make([]).limit(0)).count() == 0
    out = substring.remove_repeats(make([(1, "a b")]), carry=True).select("row.lang", "kept").collect()
    assert [tuple(r) for r in out] == [("en", "a b")]


def brute_lengths(rows, k):
    out = {}
    while True:
        owners = {}
        for d, t in rows:
            w = WORD.findall(t or "")
            for i in range(len(w) - k + 1 if d is not None else 0):
                owners.setdefault(tuple(w[i:i + k]), set()).add(d)
        hit = {d for ids in owners.values() if len(ids) > 1 for d in ids}
        if not hit:
            return out
        out.update(dict.fromkeys(hit, k))
        k *= 2


def test_repeat_lengths_double_until_nothing_survives(make):
    passages = [words(n, 100 + n) for n in (49, 50, 51, 60, 99, 100, 101, 148, 199, 200, 900)]
    rows = [(2 * i + s, words(31 + 7 * i, 200 + i + 50 * s) + " " + p + " " + words(40, 300 + 2 * i + s)) for i, p in enumerate(passages)
            for s in (0, 1)]
    both = passages[3] + " " + passages[4]  # halves that repeat in different documents make no longer repeat
    rows += [(100, both), (101, None), (102, ""), (None, passages[10]), (103, "z " * 300), (104, "z " * 120), (105, words(70, 9)),
             (105, words(70, 9)), (106, words(400, 10)), (107, words(400, 10)), (108, words(400, 10))]
    got = substring.repeat_lengths(make(rows).withColumn("h", F.lit(1)).withColumn("digest", F.lit("clash")), 50)
    want = brute_lengths(rows, 50)
    assert {r.doc_id: r.longest_repeat for r in got.collect()} == want
    assert want[20] == 800 and want[6] == 50 and 0 not in want and 105 not in want and want[106] == 400 and want[103] == 100
    assert substring.repeat_lengths(make([]).limit(0)).count() == 0


def test_repeat_lengths_miss_no_short_passage(make):
    shared = [words(60, 1000 + i) for i in range(40)]
    rows = [(2 * i + s, words(300, 3000 + 2 * i + s) + " " + p + " " + words(300, 5000 + 2 * i + s)) for i, p in enumerate(shared) for s in (0, 1)]
    assert {r.doc_id: r.longest_repeat for r in substring.repeat_lengths(make(rows)).collect()} == {d: 50 for d in range(80)}


def brute_components(rows, k=4):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]):
            x = len(sets[i] & sets[j])
            if 100 * x >= 80 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [a if c == b else c for c in comp]
    low = {}
    for c, (d, _) in zip(comp, rows):
        low[c] = d if c not in low or (d is not None and d < low[c]) else low[c]
    return [(d, len(s), low[c] if d is not None else None) for (d, _), s, c in zip(rows, sets, comp)]


def near_rows():
    r = random.Random(9)
    rows, n = [], 0
    for g in range(6):
        base = words(r.choice([6, 40, 200]), 100 + g).split()
        for _ in range(r.choice([3, 25])):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"e{r.randrange(99)}"
            rows.append((n, " ".join(w)))
            n += 1
    return rows + [(n, None), (n + 1, " \n "), (n + 2, "Two Words"), (n + 3, "two words"), (None, "two words"), (n + 4, "two")]


def test_near_copies_match_brute_force(make):
    rows = near_rows()
    out = nearcopies.near_copies(make(rows).withColumn("id", F.lit(3)).withColumn("grp", F.lit("clash")))
    assert key(tuple(r) for r in out.collect()) == key(brute_components(rows))


def test_hot_group_in_blocks_gives_the_same_components(make, monkeypatch):
    base = words(60, 77).split()
    r = random.Random(3)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"e{r.randrange(9999)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(nearcopies, "BLOCK", 16)
    assert key(tuple(r) for r in nearcopies.near_copies(make(rows)).collect()) == key(brute_components(rows))


def test_near_copies_of_an_empty_table(make):
    assert nearcopies.near_copies(make([]).limit(0)).count() == 0
