"""Functions and operators on small fixtures, against brute force where there is one."""

import itertools

import pytest
from pyspark.sql import functions as F

from popgauge.functions import hashing as H
from popgauge.functions import labels as L
from popgauge.functions import text as X
from popgauge.operators import answers as A
from popgauge.operators import joins as J
from popgauge.operators import reshape as R
from popgauge.operators import sampling as P
from popgauge.operators.impute import impute_chained


def values(spark, column, items, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r.o for r in df.select("i", column.alias("o")).orderBy("i").collect()]


def test_interval_labels():
    edges, labels = L.interval_scheme([200, 1000], "u")
    assert labels == ["< 200 u", "201–1000 u", "1001+ u"] and len(edges) == 4
    assert L.interval_scheme([200, 1000], "u", integer_style=False)[1][1] == "200–1000 u"
    assert L.interval_scheme([1, 2, 5], "x", exact=True, last_plus=True) == ([1, 2, 5, L.INF], ["1 x", "2 x", "5+ x"])
    with pytest.raises(ValueError):
        L.interval_scheme([1, 2], exact=True)


def test_cut_edges(spark):
    edges, labels = L.interval_scheme([200, 1000], "u")
    assert values(spark, L.cut("v", edges, labels), [200.0, 200.5, 1000.0, 1001.0, None, float("nan")], "double") == [
        "< 200 u", "201–1000 u", "201–1000 u", "1001+ u", None, None]
    visits = L.cut("v", [*range(11), L.INF], [*map(str, range(10)), "10+"])
    assert values(spark, visits, [0.0, 1.0, 2.0, 10.0, 11.0, -1.0], "double") == ["0", "0", "1", "9", "10+", None]
    left = L.cut("v", [18, 25, 80], ["a", "b"], right=False)
    assert values(spark, left, [17.0, 18.0, 25.0, 80.0], "double") == [None, "a", "b", None]


def test_parse_level(spark):
    col = X.parse_level("v", [["male", "man"], ["female", "woman"]])
    assert values(spark, col, ["A man.", "woman", "male or female", "n/a", "MAN", "manly", None], "string") == [0, 1, .5, None, 0, None, None]


def test_parse_answers(spark):
    assert values(spark, X.parse_number("v"), ["about -3.5 of 7", "x", "12."], "string") == [-3.5, None, 12.0]
    assert values(spark, X.parse_prob_bin("v"), ["0%", "0% - 5%", "95% - 100%", "100%", "?"], "string") == [0, .025, .975, 1, None]
    options = F.array(F.lit("a"), F.lit("b"))
    assert values(spark, X.parse_letter("v", options), [" B. why", "A", "C", "", "b"], "string") == ["b", "a", None, None, None]
    assert len(X.probability_bins()) == 22


def test_extract_tag_and_cap(spark):
    texts = ["x <STORY> one\ntwo </story> y", "# Title\n\nbody", "Analysis of it\nrest", "\n\n first \n \n second", ""]
    assert values(spark, X.extract_tag("v"), texts, "string") == ["one\ntwo", "", "", "first", ""]
    assert values(spark, X.cap_words("v", 2), ["a b  c", " a  b "], "string") == ["a b", " a  b "]
    assert values(spark, X.strip_markup("v"), ["<b>hi</b> {x} {}"], "string") == ["hi  {}"]


def test_slugify_and_names(spark):
    assert values(spark, X.slugify("v"), ["ACS: Élan vital - ½ ﬁn!", "  A--b  "], "string") == ["acs_elan_vital_12_fin", "a_b"]
    assert values(spark, X.file_to_dataset("v"), ["data/clean/acs.parquet", "gss"], "string") == ["acs", "gss"]


def test_render(spark):
    assert values(spark, X.fill("v", F.lit("1"), F.lit("2")), ["a {} b {} c", "{}", "none"], "string") == ["a 1 b 2 c", "1", "none"]
    row = spark.range(1).select(X.answer_key(F.array(F.lit("x"), F.lit("y"))).alias("k")).first()
    assert row.k == "A. x\nB. y"
    with pytest.raises(Exception, match="26"):
        spark.range(1).select(X.answer_key(F.transform(F.sequence(F.lit(1), F.lit(27)), lambda i: i.cast("string")))).collect()


def test_uniform_is_uniform(spark):
    us = spark.range(20000).select(H.uniform("id").alias("u"), H.uniform("id", stream=1).alias("v"))
    row = us.agg(F.avg("u"), F.var_pop("u"), F.corr("u", "v"), F.min("u"), F.max("u")).first()
    assert row[0] == pytest.approx(.5, abs=.01) and row[1] == pytest.approx(1 / 12, abs=.005) and abs(row[2]) < .03
    assert 0 < row[3] and row[4] < 1
    counts = us.agg(F.avg(H.poisson_one(F.col("u"))), F.var_pop(H.poisson_one(F.col("u")))).first()
    assert counts[0] == pytest.approx(1, abs=.03) and counts[1] == pytest.approx(1, abs=.06)


def test_permutations_are_all_of_them(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["x"]), (3, list("abcdefg"))], "id int, levels array<string>")
    out = A.prompt_permutations(df, "levels", "id").collect()
    four = {tuple(r.shown) for r in out if r.id == 1}
    assert four == set(itertools.permutations("abcd")) and sum(r.id == 1 for r in out) == 24
    assert [r.shown for r in out if r.id == 2] == [["x"]]
    many = [tuple(sorted(r.shown)) for r in out if r.id == 3]
    assert len(many) == 128 and set(many) == {tuple("abcdefg")}


def test_permutation_average_without_mass_is_uniform(spark):
    df = spark.createDataFrame([(1, 0, "a", 0.0), (1, 0, "b", 0.0), (1, 1, "a", 3.0), (1, 1, "b", 1.0)], "q int, perm int, lv string, m double")
    out = {r.lv: r.p for r in A.permutation_average(df, ["q"], "perm", "lv", "m").collect()}
    assert out == {"a": pytest.approx(.625), "b": pytest.approx(.375)}


def test_attach_keeps_every_fact_and_matches_null_keys(spark):
    facts = spark.range(500).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 5).alias("k"))
    lookup = spark.createDataFrame([(k, f"v{k}") for k in (0, 1, 2, None)], "k bigint, v string")
    plain = sorted(map(tuple, J.attach(facts, lookup, ["k"]).collect()), key=str)
    told = sorted(map(tuple, J.attach(facts, lookup, ["k"], bounded=True).collect()), key=str)
    assert plain == told and len(plain) == 500
    assert all(v == f"v{k}" for _, k, v in plain if k in (0, 1, 2, None))


def test_permutation_average_sums_to_one(spark):
    """Letters follow the shown order; levels without mass count 0, empty orders are uniform."""
    rows = [("q", 0, ["x", "y", "z"], {" A": 3.0, "B": 1.0, "no": 9.0}), ("q", 1, ["z", "x", "y"], {"A ": 2.0}), ("q", 2, ["y", "z", "x"], {})]
    df = spark.createDataFrame(rows, "q string, perm int, shown array<string>, masses map<string,double>")
    masses = A.letter_masses(df, ["q"], "perm", "shown", "masses")
    out = {r.level: r.p for r in A.permutation_average(masses, ["q"], "perm", "level", "mass").collect()}
    want = {"x": (0.75 + 0 + 1 / 3) / 3, "y": (0.25 + 0 + 1 / 3) / 3, "z": (0 + 1 + 1 / 3) / 3}
    assert out == {k: pytest.approx(v) for k, v in want.items()} and sum(out.values()) == pytest.approx(1)
    kept = {r.level: r.p for r in A.permutation_average(masses.where("mass > 0 OR perm = 2"), ["q"], "perm", "level", "mass").collect()}
    assert kept == {k: pytest.approx(v) for k, v in want.items()}


def test_merge_by_id_refuses_repeated_ids(spark):
    one, two = spark.createDataFrame([(1, "a"), (1, "b")], "id int, x string"), spark.createDataFrame([(1, 2)], "id int, y int")
    with pytest.raises(Exception, match="occurs twice"):
        J.merge_by_id([one, two], "id").collect()


def test_merge_by_id(spark):
    parts = [spark.createDataFrame(rows, f"id int, {c} string") for c, rows in (("a", [(1, "x"), (2, "y")]), ("b", [(2, "z"), (3, None)]), ("c", [(1, "w")]))]
    assert sorted(map(tuple, J.merge_by_id(parts, "id").collect())) == [(1, "x", None, "w"), (2, "y", "z", None), (3, None, None, None)]


def test_streams_mix_and_take_texts(spark):
    """Rows that share one lane, and neighbouring streams of one row, draw independently."""
    p, q = H.PRIMES
    rows = spark.range(4000).select("id", (F.col("id") * p).alias("lane"), F.concat(F.lit("r"), F.col("id")).alias("name"))
    draws = rows.select(*[H.uniform(k, stream=s).alias(f"{k}{s}") for k in ("id", "lane", "name") for s in (0, 1, 2)])
    pairs = [(a, b) for i, a in enumerate(draws.columns) for b in draws.columns[:i]]
    found = draws.agg(*[F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs], *[F.count_distinct(c).alias(c) for c in draws.columns]).first()
    assert all(abs(found[f"{a}_{b}"]) < 0.08 for a, b in pairs)
    assert all(found[c] == 4000 for c in draws.columns)


def test_running_total_matches_brute_force(spark):
    rows = [(i % 2, float((i * 37) % 101), float(i % 4)) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, v double, w double")
    for r in J.running_total(df, ["k"], "v", ["w"], side=2).collect():
        assert r.cum_w == pytest.approx(sum(w for k, v, w in rows if k == r.k and v <= r.v))
        assert r.tot_w == pytest.approx(sum(w for k, _, w in rows if k == r.k))


def test_sample_with_replacement_follows_weights(spark):
    df = spark.range(50).withColumn("w", (F.col("id") + 1).cast("double"))
    drawn = P.weighted_sample_replace(df, 20000, "w", ["id"])
    counts = {r.id: r["count"] for r in drawn.groupBy("id").count().collect()}
    assert sum(counts.values()) == 20000
    for i in range(50):
        assert counts.get(i, 0) == pytest.approx(20000 * (i + 1) / 1275, abs=5 * (20000 * (i + 1) / 1275) ** .5 + 5)


def test_sample_without_replacement(spark):
    df = spark.range(1000).withColumn("w", F.when(F.col("id") < 100, 50.0).otherwise(1.0))
    ids = [r.id for r in P.weighted_sample(df, 100, "w", ["id"]).collect()]
    assert len(set(ids)) == 100 and sum(i < 100 for i in ids) > 50


def test_sequence_pack_matches_brute_force(spark):
    docs = [(b, d, [f"{b}.{d}.{i}" for i in range((d * 7) % 23)]) for b in (0, 1) for d in range(12)]
    df = spark.createDataFrame(docs, "batch int, doc int, toks array<string>")
    out = {(r.batch, r.block): r.tokens for r in R.sequence_pack(df, "batch", "doc", "toks", 16).collect()}
    for b in (0, 1):
        flat = [t for bb, _, ts in docs if bb == b for t in ts]
        want = [flat[i:i + 16] for i in range(0, len(flat) // 16 * 16, 16)]
        assert [out[b, i] for i in range(len(want))] == want and (b, len(want)) not in out


def test_impute_keeps_observed_and_fills_all(spark):
    rows = [(i, "ab"[i % 2], None if i % 5 == 0 else "pq"[i % 2], None if i % 7 == 0 else float(i % 10)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a string, b string, x double")
    out = {r.id: r for r in impute_chained(df, {"b": ["a"], "x": ["a", "b"]}, ["id"], rounds=1).collect()}
    for i, a, b, x in rows:
        assert out[i].b is not None and out[i].x is not None and 0 <= out[i].x <= 9
        assert b in (None, out[i].b) and x in (None, out[i].x)
        if b is None:  # b follows a without exception among the observed rows
            assert out[i].b == "pq"["ab".index(a)]


def test_encode(spark):
    df = spark.createDataFrame([("yes", "lo", "r"), ("no", None, "g"), (None, "hi", None)], "y string, o string, c string")
    out = R.encode_categoricals(df, {"y": ["no", "yes"], "o": ["lo", "mid", "hi"], "c": ["r", "g", "b"]}, ordered=["o"])
    assert out.columns == ["y", "o", "c_r", "c_g", "c_b"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 1, 1, 0, 0), (0, 0, 0, 1, 0), (None, 3, 0, 0, 0)], key=str)


def test_buckets_are_equally_deep_whatever_the_values(spark):
    """Log-normal values with a sigma of 5 span twenty powers of ten; no bucket holds over 2 % of a group."""
    import random

    r = random.Random(3)
    rows = [(k, r.lognormvariate(0, 5), 1.0) for k in "ab" for _ in range(20_000)]
    df = spark.createDataFrame(rows, "k string, x double, w double").repartition(5).cache()
    fullest = J.equal_depth(df, ["k"], "x").groupBy("k", "_bucket").count().groupBy("k").agg(F.max("count").alias("n")).collect()
    assert len(fullest) == 2 and all(f.n < 0.02 * 20_000 for f in fullest)
    got = {(g.k, g.x): (g.cum_w, g.tot_w) for g in J.running_total(df, ["k"], "x", ["w"]).collect()}
    for k in "ab":
        mine = sorted(x for key, x, _ in rows if key == k)
        assert [got[k, x] for x in mine[::997]] == [(i + 1.0, 20_000.0) for i in range(0, 20_000, 997)]


def test_a_large_sample_is_the_same_without_one_task(spark):
    df = spark.range(5_000).withColumn("w", (F.col("id") % 7 + 1).cast("double")).repartition(6)
    want = {r.id for r in P.weighted_sample(df, 2_500, "w", ["id"]).collect()}
    out = P.weighted_sample(df, 2_500, "w", ["id"], at_once=20)
    assert {r.id for r in out.collect()} == want and out.count() == 2_500
    alike = df.withColumn("k", F.lit(0.25))
    assert sorted(r.id for r in P.smallest(alike, "k", 100, ["id"], 20).collect()) == list(range(100))
    assert P.smallest(alike, "k", 9_999, ["id"], 20).count() == 5_000


def test_draws_with_replacement_are_numbered_and_multinomial(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate([1.0, 2.0, 0.0, 5.0, None])], "id int, w double")
    counts = {}
    for seed in range(3):
        out = P.weighted_sample_replace(df, 4_000, "w", ["id"], seed=seed).collect()
        assert sorted(r.draw for r in out) == list(range(4_000))
        for r in out:
            counts[r.id] = counts.get(r.id, 0) + 1
        first = [r.id for r in sorted(out, key=lambda r: r.draw)]
        assert abs(sum(a == b for a, b in zip(first, first[1:])) / 3_999 - (1 + 4 + 25) / 64) < 0.05
    assert counts.keys() == {0, 1, 3} and all(counts[i] == pytest.approx(12_000 * w / 8, rel=0.1) for i, w in ((0, 1), (1, 2), (3, 5)))
    assert P.weighted_sample_replace(df.where("w = 0"), 5, "w", ["id"]).count() == 0


def test_folds_are_stratified_to_the_row(spark):
    df = spark.range(1_003).withColumn("y", F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b"))
    sizes = {}
    for r in J.stratified_folds(df, "y", ["id"]).groupBy("y", "fold").count().collect():
        sizes.setdefault(r.y, []).append(r["count"])
    assert sizes.keys() == {"a", "b", None} and all(len(n) == 5 and max(n) - min(n) <= 1 for n in sizes.values())
