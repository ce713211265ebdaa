"""Runs against brute force over all periods."""

import random

import numpy as np
import pytest
from corpora import awkward, blank_words, frame

from popgauge.llm import queries, runs


def brute(words, exponent=4, least=6):
    """Every maximal stretch of every period, if no smaller one fits it."""
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    r = random.Random(3)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 5_000, ["a", "b"] * 3, ["a", "b"] * 4, ["x"] + ["a", "b"] * 4 + ["b"],
           (["a", "b", "a"] * 4 + ["c"]) * 5, (["a"] * 7 + ["b"]) * 9, ["a", "a", "b"] * 5 + ["a"], [str(i) for i in range(300)]]
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    out += [list(fib[-1]), list("abc" * 5 + "bca" * 5 + "aabb" * 4)]
    for _ in range(150):
        n, k = r.randrange(1, 120), r.randrange(1, 4)
        out.append([str(r.randrange(k)) for _ in range(n)])
    for _ in range(60):
        block = [str(r.randrange(5)) for _ in range(r.randrange(1, 12))]
        tail = block * r.randrange(2, 9) + block[:r.randrange(len(block))]
        out.append([str(r.randrange(5)) for _ in range(r.randrange(30))] + tail + [str(r.randrange(5)) for _ in range(r.randrange(30))])
    return out


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 10), (2, 9)])
def test_runs_of_matches_brute_force(exponent, least):
    many = texts()
    if exponent == 2:
        many = [t[:600] for t in many]
    ids = np.array([{w: k for k, w in enumerate(sorted({w for t in many for w in t}))}[w] for t in many for w in t])
    doc = np.repeat(np.arange(len(many)), [len(t) for t in many])
    starts = np.cumsum([0, *map(len, many)])
    want = sorted((int(starts[d]) + s, length, q) for d, t in enumerate(many) for s, length, q in brute(t, exponent, least))
    assert sorted(runs.runs_of(ids, doc, exponent, least)) == want


def test_random_small_alphabet():
    r = np.random.default_rng(1)
    for trial in range(300):
        ids = r.integers(0, 2 + trial % 2, r.integers(1, 60))
        assert runs.runs_of(ids, np.zeros(len(ids), np.int64)) == brute(ids.tolist())


def rows():
    long = " ".join(["never"] * 40_000)
    return awkward() + [(500 + i, " \n".join(t)) for i, t in enumerate(texts())] + [(900, long), (None, "é é é é é é é"), (901, "w " * 3 + "x y " * 4)] * 2


def test_operator_matches_brute_force(spark):
    got = runs.runs(frame(spark, rows()).repartition(3)).collect()
    want = []
    for i, t in rows():
        words = blank_words(t)
        found = [(0, 40_000, 1)] if i == 900 else brute(words)
        want.append((i, len(words), found, collapsed(words, found)))
    assert sorted(map(repr, ((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["kept"]) for r in got))) == sorted(map(repr, want))


def test_greatest_is_exact(spark):
    big = 3_000_000_000
    df = spark.createDataFrame([(1, [(0, 13, 3), (2, 9, 2), (4, 90, 20)]), (2, [(5, big + 1, 7), (6, big, 7)]), (3, [])],
                               "k int, runs array<struct<start:bigint,length:bigint,period:bigint>>")
    got = {r["k"]: r["best"] and tuple(r["best"]) for r in df.withColumn("best", runs.greatest()).collect()}
    assert got == {1: (2, 9, 2), 2: (5, big + 1, 7), 3: None}


def test_planted_follows_its_definition():
    import zlib
    hit = 0
    for i in range(200):
        words = [str(k).encode() for k in range(1 + i % 37)]
        h = zlib.crc32(str(i).encode())
        want = list(words)
        if h % 10 == 0:
            hit, n, g = hit + 1, len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        assert queries.planted(i, words) == want
    assert hit and queries.planted(None, [b"a"]) == [b"a"]


def test_empty_table(spark):
    assert runs.runs(frame(spark, [])).count() == 0
