"""Packing, token files, sharding, pseudonyms, outliers, quality and language-model scores."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from corpora import awkward, blank_words, frame, sentence
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from popgauge.llm import outliers, packing, pseudolikelihood, pseudonyms, quality, sharding, tokens
from popgauge.llm.common import words_in_a_row
from popgauge.llm.queries import TOKENIZER
from popgauge.session import shared_path


def ids_of(text):
    return Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids


# Packing

@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_is_feasible_and_downsized(lengths):
    costs = {8: 8.0, 16: 17.0, 64: 90.0}
    lengths = sorted(lengths, reverse=True)
    bins, offsets, sizes = packing.best_fit(lengths, costs)
    held = defaultdict(list)
    for n, b, o in zip(lengths, bins, offsets):
        held[b].append((o, n))
    for b, pieces in held.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert sizes[b] == min((c for c in costs if c >= at), key=lambda c: (costs[c], c))
    assert set(held) == set(range(len(sizes)))


def test_best_fit_takes_the_fullest_bin():
    bins, _, sizes = packing.best_fit([10, 9, 6, 5, 2], {16: 16.0, 32: 40.0})
    assert bins == [0, 1, 0, 1, 1] and sizes == [16, 16]


def test_packed_covers_every_token(spark):
    rows = awkward() + [(200, sentence(random.Random(2), 9_000))] * 3
    docs = frame(spark, rows)
    lengths = packing.token_lengths(docs, TOKENIZER)
    out = packing.packed(lengths, 20, rows_per_group=10).collect()
    want = Counter((i, len(ids_of(t)) + 1) for i, t in rows)
    got = defaultdict(list)
    for r in out:
        got[r["doc_id"], r["copy"]].append((r["first"], r["n_tokens"]))
    sizes = Counter()
    for (i, _), pieces in got.items():
        at = 0
        for first, n in sorted(pieces):
            assert first == at
            at += n
        sizes[i, at] += 1
    # Rows of one id with different lengths number their copies each on their own; compare sums by id.
    assert sum(k[1] * n for k, n in want.items()) == sum(r["n_tokens"] for r in out)
    assert want == sizes

    bins = defaultdict(int)
    for r in out:
        bins[r["bin_id"], r["capacity"]] += r["n_tokens"]
    assert all(used <= capacity for (_, capacity), used in bins.items()) and len({b for b, _ in bins}) == len(bins)
    assert packing.packed(packing.token_lengths(frame(spark, []), TOKENIZER), 0).count() == 0


def test_ids_next_to_missing_ones_stay_whole(spark):
    rows = [((1 << 60) + 1, 5), ((1 << 60) + 3, 6), (None, 7), (None, 7)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint"), 4).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=repr) == sorted(rows, key=repr)


def test_encoder_holds_little_memory_over_many_tasks(spark):
    """Twenty partitions, in whatever workers they run: none grows with the number of its tasks."""
    import os
    import resource

    def grown(batches):
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        encoder = tokens.encoder_of(TOKENIZER)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                encoder.encode([" ".join(f"w{(i * 400 + k) % 20_011}" for k in range(400)).encode()])
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "before": [before], "after": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss]})

    rows = spark.range(0, 600, 1, 20).coalesce(20).mapInArrow(grown, "pid bigint, before bigint, after bigint").collect()
    for pid in {r["pid"] for r in rows}:
        mine = sorted((r["before"], r["after"]) for r in rows if r["pid"] == pid)
        assert mine[-1][1] - mine[0][1] < 50 * 1024, mine


# Token files

ENCODER = tokens.Encoder(TOKENIZER)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab1.,'\n\t   é<|endoftext|>", max_size=40), max_size=6))
def test_chunked_encoding_equals_whole(texts):
    encoder = ENCODER
    got = [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode([t.encode() for t in texts])]
    assert got == [ids_of(t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(
    [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u2003", "\u3000", "\x1c", "\x85", ".", ",", "'s", "'", "a", "ll", "\u00e9", "\u00d7", "\u00f1",
     "\u65e5", "\u2013", "1", "|", "<|endoftext|>"]), max_size=14).map("".join), max_size=6))
def test_chunks_end_at_lines_points_and_wide_blanks(texts):
    got = [np.frombuffer(b, ENCODER.kind).tolist() for b in ENCODER.encode([t.encode() for t in texts])]
    assert got == [ids_of(t) for t in texts]


def test_a_word_is_encoded_once_whatever_follows_it(monkeypatch):
    """The library sees each word once, not once with each point, comma or line behind it."""
    encoder, sent = tokens.Encoder(TOKENIZER), []
    library = encoder.tokenizer

    class Counting:
        def encode_batch_fast(self, inputs, add_special_tokens):
            sent.extend(inputs)
            return library.encode_batch_fast(inputs, add_special_tokens=add_special_tokens)

    monkeypatch.setattr(encoder, "tokenizer", Counting())
    words = [f"un{chr(97 + i % 26)}{chr(97 + i // 26)}eard" for i in range(100)]
    texts = ["so " + " ".join(f"{w}, {w}. {w}! {w}\n {w}" for w in words)] * 3
    got = [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode([t.encode() for t in texts])]
    assert got == [ids_of(t) for t in texts]
    assert sum(map(len, sent)) < 1.1 * sum(len(w) + 1 for w in words)


def test_sequences_round_trip(spark):
    rows = awkward() + [(9_000, "<|endoftext|> at  the end "), (-5, "first")]
    docs = frame(spark, rows)
    manifest = tokens.write_sequences(docs, shared_path(spark, "sequences"), TOKENIZER, length=64, batch=3)
    got = sorted(map(tuple, tokens.read_documents(spark, manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at, seen = 0, Counter()
    for doc, start, n, crc in got:
        assert start == at
        at += n
        seen[doc, n, crc] += 1
    assert seen == Counter((i, len(x) + 1, zlib.crc32(np.array(x + [0], "<u4").tobytes())) for i, t in rows for x in [ids_of(t)])
    stream = []
    for m in manifest:
        ids, _ = tokens.open_sequences(m["path"])
        held = []
        for number in range(-(-m["n_tokens"] // 64)):
            row, mask = tokens.sequence(ids, number, batch=3)
            assert len(row) == len(mask) == 64 and not row.flags.owndata
            held += row[mask].tolist()
        assert len(held) == m["n_tokens"]
        stream += held
    assert len(stream) == at
    empty = tokens.write_sequences(frame(spark, []), shared_path(spark, "sequences"), TOKENIZER)
    assert empty == [] and tokens.read_documents(spark, empty).count() == 0


# Sharding

def slow_shard(key, shards, weights=None, base=40):
    """Region, rack and shard by descent from the root of a tree of ``base`` leaves; later leaves draw against the root."""
    import hashlib
    import math

    def draw(node, rate):
        u = (int(hashlib.md5(f"{node}:{key}".encode()).hexdigest()[:12], 16) + 0.5) / 2 ** 48
        return -math.log(u) / rate

    weight = lambda s: (weights or {}).get(s, 1.0)
    below = lambda per, n: sum(weight(s) for s in range(base) if s // per == n)
    least, region = min((draw(f"region{r}", below(20, r)), r) for r in range(base // 20))
    rack = min((draw(f"rack{k}", below(5, k)), k) for k in range(base // 5) if k // 4 == region)[1]
    shard = min((draw(f"shard{s}", weight(s)), s) for s in range(base) if s // 5 == rack)[1]
    late = [s for s in range(base, shards) if draw(f"shard{s}", weight(s)) < least]
    return late[0] if late else shard


@pytest.mark.parametrize("weights", [None, {0: 3.0, 7: 0.25}])
def test_hash_tree(spark, weights):
    rows = awkward() + [(i, "x") for i in range(1000, 1400)] + [(77, "same")] * 30
    out = sharding.place(frame(spark, rows), 40, weights=weights, rows_per_bucket=3).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in out:
        key = "null" if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == slow_shard(key, 40, weights) and r["grown_shard"] == slow_shard(key, 41, weights)
        assert r["grown_shard"] in (r["shard"], 40) and (r["region"], r["rack"]) == (r["shard"] // 20, r["shard"] // 5)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.place(frame(spark, []), 40).count() == 0


def test_hash_tree_moves_along_the_changed_path(spark):
    """Keys go by weight, and move only into, out of or below nodes whose weights change; a new leaf takes its share."""
    rows = frame(spark, [(i, "x") for i in range(6_000)])
    before, after = ({r["doc_id"]: r for r in sharding.place(rows, 40, weights=w).collect()} for w in (None, {7: 6.0}))
    moved = 0
    for i, old in before.items():
        new = after[i]
        moved += old["shard"] != new["shard"]
        assert old["shard"] == new["shard"] or 0 in (old["region"], new["region"])
        if old["region"] == new["region"] and 1 not in (old["rack"], new["rack"]):
            assert old["shard"] == new["shard"]
        if old["rack"] == new["rack"] and 7 not in (old["shard"], new["shard"]):
            assert old["shard"] == new["shard"]
    assert 0 < moved < 2_000
    shares = Counter(r["shard"] for r in after.values())
    assert abs(shares[7] / 6_000 - 6 / 45) < 0.02 and all(abs(shares[s] / 6_000 - 1 / 45) < 0.01 for s in range(40) if s != 7)
    grown = Counter(r["grown_shard"] for r in before.values())
    assert abs(grown[40] / 6_000 - 1 / 41) < 0.01


# Pseudonyms

def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def changed(spark, texts, key="k"):
    rows = pseudonyms.with_counts(frame(spark, list(enumerate(texts))), key).collect()
    return [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])], sum(r["n_replaced"] for r in rows)


def test_pseudonyms_keep_format_and_links(spark):
    texts = ["4111 1111 1111 1111 x 4111111111111111", "+1 (743) 555-3824 or 743-555-3824.", "8.196.197.208!!", "2024-02-29 29/02/2024 2024/02/29",
             "123-45-6789", "hein.19@mail5.example.com###", 'token = "e03422dad6b454724135a384f69ba12c7de6c8f4"', "again 4111111111111111"]
    out, n = changed(spark, texts)
    assert n == 12
    a, b = re.fullmatch(r"(\d{4} \d{4} \d{4} \d{4}) x (\d{16})", out[0]).groups()
    assert a.replace(" ", "") == b != "4111111111111111" and luhn(b) and out[7] == f"again {b}"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}\.", out[1])
    one, two = re.findall(r"\d{3}\D+\d{3}-\d{4}", out[1])
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two) != "7435553824"
    assert all(int(o) < 256 for o in re.fullmatch(r"(\d+)\.(\d+)\.(\d+)\.(\d+)!!", out[2]).groups())
    iso, day, year = out[3].split(" ")
    assert iso == "-".join(reversed(day.split("/"))) == year.replace("/", "-") != "2024-02-29"
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", out[4]) and out[4] != texts[4]
    assert re.fullmatch(r"[a-z]{4}\.\d\d@mail5\.example\.com###", out[5]) and out[5] != texts[5]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[6]) and out[6] != texts[6]
    assert changed(spark, texts)[0] == out and changed(spark, texts, "other")[0] != out


def test_pseudonyms_of_capital_keys_and_month_first_dates(spark):
    key = "e03422dad6b454724135a384f69ba12c7de6c8f4"
    (out, *_), n = changed(spark, [f'TOKEN = "{key.upper()}" token = "{key}" {key.upper()[:20] + key[20:]}'])
    upper, lower, mixed = re.fullmatch(r'TOKEN = "([0-9A-F]{40})" token = "([0-9a-f]{40})" ([0-9A-F]{20}[0-9a-f]{20})', out).groups()
    assert n == 3 and upper.lower() == lower != key and mixed.lower() != key
    days = np.arange(np.datetime64("1800-01-01"), np.datetime64("2200-01-01")).astype(str)
    late = [f"{d[5:7]}/{d[8:]}/{d[:4]}" for d in days if int(d[8:]) > 12]
    assert len(late) == 88_497
    some = sorted({*late[:60], *late[::149], *late[-60:]})
    written = changed(spark, some)[0]
    assert len(set(written)) == len(some) and set(written) <= set(late)
    out, n = changed(spark, ["born 03/25/1990", "03/04/1990", "25/03/1990", "02/30/1990 13/13/1990 03/25/1700"])
    assert n == 3 and out[0] != "born 03/25/1990" and out[3] == "02/30/1990 13/13/1990 03/25/1700"
    assert re.fullmatch(r"born (0[1-9]|1[0-2])/(1[3-9]|2\d|3[01])/\d{4}", out[0])


def test_invalid_values_and_other_text_stay(spark):
    texts = ["4111111111111112", "999.1.1.1 and 1.2.3", "2023-02-29", "666-45-6789 000-12-3456", "Version 2.0, 12345, 3.14", "", None, "a@b", "x" * 100_000, "\U0001F600 é"]
    assert changed(spark, texts) == (texts, 0)
    docs = frame(spark, awkward())
    same = pseudonyms.pseudonymised(docs, "k")
    assert same.columns == docs.columns and sorted(map(str, same.collect())) == sorted(map(str, docs.collect()))
    assert pseudonyms.with_counts(frame(spark, []), "k").count() == 0


def test_feistel_permutes(spark):
    from pyspark.sql import functions as F
    df = spark.range(0, 7 * 5 * 3).select(F.array(F.col("id") % 7, F.floor(F.col("id") / 7) % 5, F.floor(F.col("id") / 35)).alias("v"))
    bases = F.array(*[F.lit(b).cast("bigint") for b in (7, 5, 3)])
    found = [tuple(r[0]) for r in df.select(pseudonyms.feistel(F.col("v"), bases, "t", "k")).collect()]
    assert len(set(found)) == 105 and all(a < 7 and b < 5 and c < 3 for a, b, c in found)


# Robust outliers

def slow_counts(text):
    w = blank_words(text)
    times = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if times[tuple(w[i:i + 3])] > 1 for p in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if blank_words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_base_rules(spark):
    rows = awkward() + [(300, "a|b <c> # * $ % &\na|b <c> # * $ % &\n"), (301, "p q r s p q r t u p q"), (302, "a b c " * 40)]
    out = outliers.judged(frame(spark, rows)).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out)
    assert got == Counter((i, *slow_counts(t)) for i, t in rows)
    sound = [r for r in out if not r["base_failed"]]  # few rows: one pooled cell
    x = np.array([[
        np.log((q["word_chars"] + 50) / (q["n_words"] + 10)), np.sqrt(q["n_symbols"] / (q["word_chars"] + 100)), np.sqrt(q["n_dup_lines"] / (q["n_lines"] + 5)),
        np.sqrt(q["n_repeat_words"] / (q["n_words"] + 30)), np.sqrt(q["n_upper"] / (q["word_chars"] + 100))] for q in sound])
    want, found = slow_mcd(x), np.array([r["distance"] for r in sound])
    assert np.corrcoef(np.log(found), np.log(want))[0, 1] > 0.95
    assert all(r["kept"] == (r["distance"] <= outliers.CUTOFF) for r in sound) and not any(r["kept"] for r in out if r["base_failed"])
    for few in (rows[:4], [(1, " ".join(f"v{i}" for i in range(60)))]):  # no sound row, and one
        small = outliers.judged(frame(spark, few[:4])).collect()
        assert len(small) == len(few) and all(r["kept"] == (not r["base_failed"]) for r in small if r["doc_id"] is not None)
    assert outliers.judged(frame(spark, [])).count() == 0


def slow_mcd(x):
    """The same concentration steps in numpy, with exact order statistics."""
    floors = np.diag(np.square(outliers.FLOORS))

    def distances(centre, cov):
        d = x - centre
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    centre = np.median(x, axis=0)
    ends = []
    for now in ((x.mean(0), np.cov(x.T, bias=True) + floors), (centre, np.diag(np.square(1.4826 * np.median(abs(x - centre), axis=0))) + floors)):
        for _ in range(outliers.STEPS):
            near = x[distances(*now) <= np.quantile(distances(*now), outliers.SUBSET)]
            now = near.mean(0), np.cov(near.T, bias=True) + floors
        ends.append(now)
    best = distances(*min(ends, key=lambda e: np.linalg.slogdet(e[1])[1]))
    return best / max(1.0, np.median(best) / outliers.CHI_MEDIAN)


def test_outliers_match_numpy(spark):
    r = random.Random(4)
    rows = [(i, " ".join("abcdefgh"[: r.randrange(1, 8)] + str(r.randrange(900)) for _ in range(80))) for i in range(400)]
    rows += [(400 + i, " ".join(f"Z{r.randrange(900)}$$$|" for _ in range(80))) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", None) for i, t in rows], "doc_id bigint, text string, lang string, source string")
    out = sorted(outliers.judged(docs).collect(), key=lambda q: q["doc_id"])
    x = np.array([[
        np.log((q["word_chars"] + 50) / (q["n_words"] + 10)), np.sqrt(q["n_symbols"] / (q["word_chars"] + 100)), np.sqrt(q["n_dup_lines"] / (q["n_lines"] + 5)),
        np.sqrt(q["n_repeat_words"] / (q["n_words"] + 30)), np.sqrt(q["n_upper"] / (q["word_chars"] + 100))] for q in out])
    want = slow_mcd(x)
    got = np.array([q["distance"] for q in out])
    assert np.corrcoef(np.log(got), np.log(want))[0, 1] > 0.99 and (abs(np.log(got / want)) < 0.2).mean() > 0.9
    assert [q["kept"] for q in out] == [i < 400 for i, _ in rows]


# Quality

def test_quality_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.scores(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert len(held) > 40 and sum(a == b for a, b in held) / len(held) >= 0.95


def test_quality_of_awkward_tables(spark):
    docs = frame(spark, awkward())
    for labels in ([], [(6, 1), (6, 0), (13, 0), (None, 1), (9, None), (12, 1), (20, 1), (21, 0)]):
        table = spark.createDataFrame(labels, "doc_id bigint, quality int")
        out = quality.scores(docs, table).collect()
        assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
        assert labels or {r["score"] for r in out} == {0.5 * 0.99 + 0.01 * 0.5}
        kept = quality.accepted(docs, table)
        assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in out)
    assert quality.scores(frame(spark, []), table).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5), st.integers(0, 10)), min_size=1, max_size=12))
def test_pooled_is_monotone_and_keeps_the_sum(cells):
    w, m = np.array([c[0] for c in cells], float), np.array([c[1] for c in cells], float)
    fit = quality.pooled(w, m)
    assert (np.diff(fit) >= -1e-9).all() and np.isclose((w * fit).sum(), (w * m).sum())


# Pseudo-likelihood

def test_gradients_match_differences():
    random_ = np.random.default_rng(0)
    model = [m.astype(np.float64) for m in pseudolikelihood.start()]
    around, classes = random_.integers(0, 50, (6, 4)), random_.integers(0, pseudolikelihood.CLASSES, 6)
    _, out, bias = pseudolikelihood.gradients(model, around, classes)
    for part, place, want in ((1, (3, 5), out[3, 5]), (2, (7,), bias[7])):
        sides = []
        for move in (1e-5, -1e-5):
            shifted = [m.copy() for m in model]
            shifted[part][place] += move
            sides.append(-pseudolikelihood.log_probabilities(shifted, around, classes).mean())
        assert np.isclose((sides[0] - sides[1]) / 2e-5, want, rtol=1e-3, atol=1e-7)


def test_windows_see_both_sides_only():
    got = pseudolikelihood.windows([np.array([5, 6, 7], np.int32), np.array([], np.int32), np.array([8], np.int32)])
    assert got.tolist() == [[0, 0, 6, 7], [0, 5, 7, 0], [5, 6, 0, 0], [0, 0, 0, 0]]


def test_scores_sum_conditional_log_probabilities(spark):
    rows = awkward()
    docs = frame(spark, rows)
    words = pseudolikelihood.lexicon(docs.select("text"))
    counts = Counter(w for _, t in rows for w in (t or "").encode().lower().split())
    assert {w: n for w, (_, n) in words.listed.items()} == counts
    assert sum(words.totals) == sum(counts.values())
    model = pseudolikelihood.trained(docs.select("doc_id", "text"), words)
    out = pseudolikelihood.scored(docs).collect()
    got = Counter((r["doc_id"], r["n_tokens"]) for r in out)
    assert got == Counter((i, len((t or "").encode().lower().split())) for i, t in rows)
    for i, text in (rows[5], rows[10]):
        total = 0.0
        row, cls, share = words.numbers(text.encode().lower().split())
        line = [0, 0, *row.tolist(), 0, 0]
        for at in range(len(row)):
            around = np.array([[line[at + 2 + o] for o in pseudolikelihood.OFFSETS]])
            total += pseudolikelihood.log_probabilities(model, around, cls[at:at + 1])[0] + share[at]
        found = next(r for r in out if r["doc_id"] == i)
        assert np.isclose(found["log_likelihood"], total, rtol=1e-3)
    assert all(r["mean_log_likelihood"] is None for r in out if r["n_tokens"] == 0)
    assert pseudolikelihood.scored(frame(spark, [])).count() == 0


def test_words_of_many_texts_are_looked_up_together():
    """A lot of texts asks the lexicon for each word a few times at most, and gives what each text by itself does."""
    texts = [(t or "").encode().lower() for _, t in awkward()] + [b" \x0b lead and\x0ctrail\r", b"x \x1c y \xc2\xa0 z"]
    split = [t.split() for t in texts]
    counts = Counter(w for words in split for w in words)
    lexicon = pseudolikelihood.Lexicon(sorted(counts.items(), key=lambda w: (-w[1], w[0]))[:300], sum(counts.values()))
    distinct, which, sizes = words_in_a_row(texts)
    assert [distinct[i] for i in which.tolist()] == [w for words in split for w in words] and sizes.tolist() == list(map(len, split))
    assert len(distinct) < 2 * len(counts) < len(which) // 2
    found = [column[which] for column in lexicon.numbers(distinct)]
    alone = [np.concatenate(columns) for columns in zip(*map(lexicon.numbers, split))]
    assert all(f.dtype == a.dtype and (f == a).all() for f, a in zip(found, alone))
    unlisted = found[1] == pseudolikelihood.UNLISTED
    assert 0 < unlisted.sum() < len(which) and (found[0][unlisted] > pseudolikelihood.OWN).all() and found[0].min() > 0
    assert words_in_a_row([])[0] == [] and [len(c) for c in lexicon.numbers([])] == [0, 0, 0]


def test_words_outside_the_list_have_their_share(spark, monkeypatch):
    """Of documents of one word the context is the same, so within a class scores differ by the counts' logarithms."""
    monkeypatch.setattr(pseudolikelihood, "LISTED", 45)
    rows, counts = [], Counter({f"v{i}": 60 + i for i in range(40)} | {f"r{i}": 1 + i % 30 for i in range(300)})
    for word, n in counts.items():
        rows += [(len(rows) + k, word) for k in range(n)]
    words = pseudolikelihood.lexicon(frame(spark, rows).select("text"))
    assert len(words.listed) <= 45
    found = {rows[r["doc_id"]][1]: r["log_likelihood"] for r in pseudolikelihood.scored(frame(spark, rows)).collect()}
    by_class = defaultdict(list)
    for word, n in counts.items():
        by_class[words.class_of(word.encode())].append((found[word] - np.log(n), n))
    assert all(np.ptp([base for base, _ in c]) < 1e-6 for c in by_class.values())
    assert all(words.totals[c] == sum(n for _, n in members) for c, members in by_class.items())
    assert np.isclose(sum(np.exp(v) for v in found.values()), 1, atol=0.05)


def test_network_learns_context(spark):
    """Words that only their neighbours tell apart become likelier than by their frequency."""
    r = random.Random(6)
    pairs = [("left", "right"), ("up", "down"), ("hot", "cold")]
    rows = [(i, " ".join(w for _ in range(100) for w in r.choice(pairs))) for i in range(300)]
    out = pseudolikelihood.scored(frame(spark, rows)).collect()
    assert sum(r["log_likelihood"] for r in out) / sum(r["n_tokens"] for r in out) > np.log(1 / 6) + 0.8


def test_scores_do_not_depend_on_partitions(spark):
    r = random.Random(7)
    rows = awkward() + [(100 + i, " ".join(r.choice(["left right", "up down", sentence(r, 2, 3_000)]) for _ in range(60))) for i in range(200)]
    rows += [(1_000 + i, "the same text in a third of all rows") for i in range(100)]
    found = []
    for parts in (1, 4, 32):
        out = pseudolikelihood.scored(frame(spark, rows).repartition(parts)).collect()
        found.append(sorted((str(q["doc_id"]), q["n_tokens"], q["log_likelihood"]) for q in out))
    for other in found[1:]:
        assert [x[:2] for x in other] == [x[:2] for x in found[0]]
        assert np.allclose([x[2] for x in other], [x[2] for x in found[0]], rtol=1e-3)


def test_training_beats_word_frequencies():
    """The start is the word frequencies; sums over any split of the texts are the same, and steps only gain."""
    r = np.random.default_rng(3)
    texts = [(c + 1, c) for c in (np.repeat(r.integers(0, 30, 40), 2).astype(np.int32) for _ in range(50))]
    model = pseudolikelihood.start()
    whole, parts = pseudolikelihood.Gradients(model), pseudolikelihood.Gradients(model)
    whole.add(texts)
    for at in range(0, 50, 7):
        parts.add(texts[at:at + 7])
    assert whole.tokens == parts.tokens == 4_000
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(whole.sums, parts.sums))
    around, classes = pseudolikelihood.windows([t for t, _ in texts]), np.concatenate([c for _, c in texts])
    direct = pseudolikelihood.gradients([m.astype(np.float64) for m in model], around, classes)[0] * len(classes)
    for p in range(len(pseudolikelihood.OFFSETS)):
        want = np.zeros_like(whole.sums[0][p])
        np.add.at(want, around[:, p], direct)
        assert np.allclose(whole.sums[0][p], want, atol=1e-3)
    descent = pseudolikelihood.Descent(model)
    before = pseudolikelihood.log_probabilities(model, around, classes).mean()
    for _ in range(8):
        now = pseudolikelihood.Gradients(descent.model)
        now.add(texts)
        descent.step(now.sums, now.tokens)
    assert pseudolikelihood.log_probabilities(descent.model, around, classes).mean() > before + 0.5
