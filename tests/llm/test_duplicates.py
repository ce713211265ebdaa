"""SimHash, substring removal and decontamination against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from corpora import awkward, blank_words, classes, frame, sentence
from hypothesis import given, settings
from hypothesis import strategies as st

from popgauge.llm import decontaminate, simhash, substrings
from popgauge.llm.components import components


def by_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# Connected components

@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 50), (7, 7)], []])
def test_components(spark, edges):
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    pairs = {frozenset(e) for e in edges if e[0] != e[1]}
    root = classes(60, lambda i, j: frozenset((i, j)) in pairs)
    nodes = {n for p in pairs for n in p}
    assert {r["node"]: r["root"] for r in found} == {n: root[n] for n in nodes}


# SimHash

def slow_print(text, words=3):
    split = (text or "").encode().lower().split()
    runs = [b" ".join(split[i:i + words]) for i in range(max(1, len(split) - words + 1))] if split else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("expand", [32, 1])
def test_fingerprint_classes(spark, monkeypatch, expand):
    """``expand`` 1 sends every posting down the way for crowded ones."""
    monkeypatch.setattr(simhash, "EXPAND", expand)
    rows = awkward()
    prints = [slow_print(t) for _, t in rows]
    root = classes(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, root)), key=str)
    assert by_rows(simhash.fingerprint_classes(frame(spark, rows))) == want


def test_crowded_fingerprints_keep_every_link(spark):
    r = random.Random(3)
    centre = r.getrandbits(64)
    prints = {centre, *(centre ^ 1 << b for b in range(40)), *(centre ^ 1 << b ^ 1 << r.randrange(64) for b in range(64)), *(r.getrandbits(64) for _ in range(50))}
    signed = sorted(int(np.uint64(p).view(np.int64)) for p in prints)
    found = {r["node"]: r["root"] for r in simhash.linked(spark.createDataFrame([([p],) for p in signed], "lanes array<bigint>")).collect()}
    root = classes(len(signed), lambda i, j: ((signed[i] ^ signed[j]) & (1 << 64) - 1).bit_count() <= 2)
    sizes = Counter(root)
    assert found == {signed[i]: signed[r] for i, r in enumerate(root) if sizes[r] > 1}


@pytest.mark.parametrize("shape", [(8, 6, 4), (16, 5, 3), (8, 6, 2)])
def test_keys_cover_every_guaranteed_match(shape):
    from itertools import combinations
    keys = list(map(set, simhash.cover(*shape)))
    assert all(any(k <= set(equal) for k in keys) for equal in combinations(range(shape[0]), shape[1]))


def edited(r, words, every):
    return [f"e{r.random()}" if i % every == every // 2 else w for i, w in enumerate(words)]


@pytest.mark.parametrize("expand", [32, 2])
def test_one_of_each_class(spark, monkeypatch, expand):
    """Of each class of linked fingerprints the row with the least id stays, whatever the ids, and all columns with it."""
    monkeypatch.setattr(simhash, "EXPAND", expand)
    r = random.Random(5)
    rows = []
    for g in range(8):
        base = [f"g{g}v{r.randrange(300)}" for _ in range(1_500)]
        for k in range(8):
            rows.append((len(rows), " ".join(edited(r, base, 701 + 7 * k) if k else base)))
    rows += [(None, rows[0][1]), (None, "alone without an id " * 9), (None, "alone without an id " * 9), (500, None), (501, ""), (502, "  "), (5, rows[5][1])]
    rows += [(70, "one text of id seventy and more"), (70, "another text with the same id here"), (71, "a third text, of another id altogether"), (71, "a third text, of another id altogether")]
    r.shuffle(rows)
    prints = [simhash.fingerprint(simhash.shingles((t or "").encode(), 3))[0] & (2 ** 64 - 1) for _, t in rows]
    root = classes(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    want = Counter()
    for c in set(root):
        ids = [rows[i][0] for i in range(len(rows)) if root[i] == c]
        want[min((i is None, i or 0) for i in ids)] += 1
    docs = frame(spark, rows).repartition(3)
    kept = simhash.one_of_each(docs).collect()
    assert Counter((k["doc_id"] is None, k["doc_id"] or 0) for k in kept) == want and want[True, 0] == 1
    assert docs.columns == list(kept[0].asDict()) and len(set(root)) < 40
    assert sorted(k["text"] for k in kept if k["doc_id"] in (70, 71)) == sorted({t for i, t in rows if i in (70, 71)})


def test_rows_that_share_an_id_are_not_lost(spark):
    rows = [(1, "this text is the first of them"), (1, "quite another one under the same number"), (2, "and a third that nothing resembles")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS _node", "1 AS row")
    assert sorted(tuple(r)[:2] for r in simhash.one_of_each(docs).collect()) == sorted(rows)


def test_empty_corpus_of_fingerprints(spark):
    none = frame(spark, [])
    assert simhash.fingerprint_classes(none).count() == 0 and simhash.one_of_each(none).count() == 0


# Substring removal

def slow_removal(rows, window=35):
    split = [blank_words(t) for _, t in rows]
    starts = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, split):
        gone = {p for s in range(len(w) - window + 1) if starts[tuple(w[s:s + window])] > 1 for p in range(s, s + window)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent", [4_096, 1])
def test_substring_removal(spark, monkeypatch, frequent):
    """``frequent`` 1 makes each window of a repeated anchor a piece of its own."""
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 500)
    rows = awkward() + [(99, "b " * 90), (98, "c d e " * 40)]
    assert by_rows(substrings.deduplicated(frame(spark, rows)).drop("spans")) == slow_removal(rows)
    assert substrings.deduplicated(frame(spark, [])).count() == 0


def test_pieces_of_documents_in_a_row(monkeypatch):
    """Documents are cut many at once: as each is by itself, and a word is hashed once, not at each place."""
    texts = [(t or "").encode() for _, t in awkward()] + [b" \x0b a b\x0cc\r", b"x \x1c y \xc2\xa0 z", b"b " * 34, b"b " * 35, b"b " * 36]
    hashed, digest = [], substrings.xxhash.xxh64_intdigest
    monkeypatch.setattr(substrings.xxhash, "xxh64_intdigest", lambda word: hashed.append(word) or digest(word))
    x, sizes = substrings.word_numbers(texts)
    split = [blank_words(t.decode()) for t in texts]
    assert sizes.tolist() == list(map(len, split)) and x.tolist() == [digest(w.encode()) for words in split for w in words]
    assert len(hashed) < 700 < 2_000 < len(x)
    hot = np.sort(substrings.Pieces(x, sizes, 35, x[:0]).anchor[::7])
    for frequent in (x[:0], hot):
        got = substrings.Pieces(x, sizes, 35, frequent)
        places = [got.text, got.start, got.count, got.anchor, got.piece]
        alone = []
        for i, part in enumerate(np.split(x, np.cumsum(sizes)[:-1])):
            one = substrings.Pieces(part, sizes[i:i + 1], 35, frequent)
            alone += [(i, *row) for row in zip(*(c.tolist() for c in (one.start, one.count, one.anchor, one.piece)))]
        assert list(zip(*(c.tolist() for c in places))) == alone and len(alone) > 100
    lots = [sizes[some].tolist() for some in substrings.lots(sizes, 200)]
    assert sum(lots, []) == sizes.tolist() and len(lots) > 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=14), st.integers(1, 3)), max_size=6), st.integers(2, 5))
def test_automaton_counts(texts, window):
    automaton = substrings.Automaton()
    for words, weight in texts:
        automaton.add(words, weight)
    automaton.close()
    times = Counter()
    for words, weight in texts:
        for i in range(len(words) - window + 1):
            times[tuple(words[i:i + window])] += weight
    for words, _ in texts:
        want = sum(1 << i for i in range(len(words) - window + 1) if times[tuple(words[i:i + window])] > 1)
        assert automaton.repeats(words, window) == want


# Decontamination

def test_contamination(spark):
    import re
    r = random.Random(9)
    items = [(i, sentence(r, 25).upper() + ".") for i in range(8)] + [(8, "short item here"), (None, sentence(r, 12)), (10, None), (11, "..."), (3, sentence(r, 11))]
    rows = awkward() + [(100, sentence(r, 40) + "; " + items[0][1].replace(" ", ", ") + " " + sentence(r, 10)), (101, "x short ITEM here y"),
                        (102, items[1][1] + items[2][1] + items[1][1]), (103, items[-4][1] + " " + items[9][1]), (104, " ".join(items[4][1].split()[:9]))]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    phrases = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            phrases.setdefault(tuple(w[s:s + 10]), set()).add("null" if i is None else str(i))
    want = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for s in range(len(w)):
            for p, owners in phrases.items():
                if tuple(w[s:s + len(p)]) == p:
                    hit |= set(range(s, s + len(p)))
                    found |= owners
        want.append((i, len(w), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for options in ({}, {"block_items": 3, "shard_words": 200}):
        got = decontaminate.contamination(frame(spark, rows), bench, **options)
        assert by_rows(got.select("doc_id", "n_words", "n_hit", "items_sha256")) == sorted(want, key=str)
    clean = decontaminate.decontaminated(frame(spark, rows), bench)
    assert clean.columns == frame(spark, rows).columns
    again = decontaminate.contamination(clean, bench).agg({"n_hit": "sum"}).first()[0]
    assert again == 0
    texts = Counter((r["doc_id"], r["text"]) for r in clean.collect())
    assert all(texts[i, t] for (i, t), w in zip(rows, want) if w[2] == 0)
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(frame(spark, rows), none).where("n_hit > 0").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 4), min_size=3, max_size=3), min_size=1, max_size=5))
def test_fm_index(text, phrases):
    index = decontaminate.FmIndex(np.array(text), 4, every=3)
    found, low, high = index.search(np.array(phrases))
    got = {p: sorted(index.locate(np.arange(a, b)).tolist()) for p, a, b in zip(found.tolist(), low, high)}
    want = {p: [i for i in range(len(text) - 2) if text[i:i + 3] == phrase] for p, phrase in enumerate(phrases)}
    assert got == {p: places for p, places in want.items() if places}


def test_benchmark_blocks_hold_each_row_once(spark):
    """Long texts are blocks of their own; rows equal in item and text come once; NULL texts have no words."""
    rows = [(f"i{k % 40}", f"text number {k % 40}") for k in range(80)] + [("long", "word " * 40), ("long", "word " * 40), (None, "text of no item"), ("none", None)]
    table = spark.createDataFrame(rows, "i string, t string")
    blocks = list(decontaminate._blocks(table, "i", "t", 10, block_bytes=100))
    assert sorted(r for b in blocks for r in b) == sorted({(i or "null", t.encode()) for i, t in rows if t is not None})
    assert all(len(b) == 1 for b in blocks if any(len(t) > 100 for _, t in b)) and len(blocks) > 4
    assert [b for b in decontaminate._blocks(table.limit(0), "i", "t", 10)] == []
