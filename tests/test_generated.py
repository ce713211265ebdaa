"""Queries whose rows pass through one generated method each: it has to stay below what the JVM compiles."""

import re

import numpy as np
from pyspark.sql import functions as F

from popgauge.functions import hashing as H
from popgauge.functions.text import ascii_fold, normalise_name, slugify
from popgauge.operators.boosting import training_cells
from popgauge.operators.cells import bootstrap_cells
from popgauge.plans import builds as B
from popgauge.spec import HighDimTask

#: Bytes of bytecode beyond which the JVM leaves a method to its interpreter.
HUGE = 8000
TASK = HighDimTask(1, "scf", "out", ("x", "y"))


def largest_method(df):
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        told = spark._jvm.PythonSQLUtils.explainString(df.select("*")._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    return max(map(int, re.findall(r"maxMethodCodeSize:(-?\d+)", told)))


def respondents(spark, n=200):
    return spark.range(n).select(
        F.col("id"), (F.col("id") % 7).alias("line"), F.when(F.col("id") % 3 == 0, "yes").otherwise("no").alias("out"),
        F.concat(F.lit("a"), F.col("id") % 5).alias("x"), F.concat(F.lit("b"), F.col("id") % 2).alias("y"), (F.col("id") % 4 + 1.0).alias("weight"))


def test_replicates_of_a_row_are_compiled(spark):
    assert largest_method(bootstrap_cells(respondents(spark), [TASK], ["id", "line", "x"])) < HUGE


def test_counts_are_those_of_single_draws(spark):
    keyed = respondents(spark).withColumn("k", H.key_sum("id", "line", "x"))
    streams = range(3, 9)
    one = F.array(*[H.poisson_one(H.stream_uniform(F.col("k"), s)).cast("tinyint") for s in streams])
    rows = keyed.select(H.poisson_counts(F.col("k"), streams).alias("got"), one.alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows] and len({tuple(r["got"]) for r in rows}) > 50
    assert keyed.limit(0).select(H.poisson_counts(F.col("k"), streams)).collect() == []


def test_draws_keep_their_values_at_the_ends_of_the_lanes(spark):
    """Products are reduced once for two of them; Python's whole numbers tell what every step must give."""
    p, q = H.PRIMES
    keys = [a * H.LANE + b for a in (0, 1, p - 1) for b in (0, 1, q - 1)]

    def exact(k, stream):
        terms, drawn = H.stream_terms(stream), []
        for prime, (by_a, by_b, plus) in zip(H.PRIMES, (terms[:3], terms[3:])):
            x = ((k >> 31) * by_a + (k & (H.LANE - 1)) * by_b + plus) % prime
            drawn.append((x ** 3 + x * H.CUBIC[0] + H.CUBIC[1]) % prime)
        return drawn[0] * q + drawn[1]

    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for stream in (0, 42, 1009, p - 1):
        assert [r[0] for r in df.select(H.stream_hash(F.col("k"), stream)).collect()] == [exact(k, stream) for k in keys]
        want = [(float(exact(k, stream)) + 0.5) / float(H.RANGE) for k in keys]
        assert H.uniform_array(np.array(keys), [stream])[:, 0].tolist() == want


def test_boosting_cells_carry_the_counts_of_single_draws(spark):
    rows = respondents(spark)
    cells = training_cells(rows, [TASK], ["id", "line"], folds=2, seed=0, replicates=2)
    got = cells.read().agg(*[F.sum(F.col("w")[b]) for b in range(3)]).first()
    drawn = [H.poisson_one(H.uniform("id", "line", stream=1000 + b)) for b in range(2)]
    assert list(got) == list(rows.agg(F.sum("weight"), *[F.sum(F.col("weight") * c) for c in drawn]).first())


def test_occupations_are_named_once(spark):
    rows = [("Other designers 12-", "10", "50", "60", "10", "5"), ("Bus drivers, transit and intercity", "10", "50", "60", "10", "5"),
            ("Military specific occupations", "1", "1", "1", "1", "1"), (None, "1", "1", "1", "1", "1"), ("All OTHER cooks", "1", "1", "1", "1", "1"),
            ("Full-time Cooks 3", "-", "50", "60", "10", "5"), ("Nurses 1-2", "20", "25", "60", "–", "5"), ("Nurses 1-2", "20", "25", "60", "10", "5")]
    raw = spark.createDataFrame(rows, "occupation string, total string, female string, white string, black string, asian string")
    built = B.labor(raw)
    assert largest_method(built) < HUGE
    got = {(r["occupation"], r["sex"], r["race"]): r["weight"] for r in built.where("weight IS NOT NULL").collect()}
    assert {k[0] for k in got} == {"transit and intercity bus driver", "nurses"}
    assert got["nurses", "female", "white"] == 3.0 and got["nurses", "male", "other"] == 3.75
    # The row without a number for one race has cells for the others.
    assert sorted(r["weight"] for r in built.where("occupation = 'nurses' AND sex = 'male' AND race = 'asian'").collect()) == [0.75, 0.75]


def test_a_filter_on_a_renamed_name_cuts_it_once(spark):
    name = normalise_name("n", renames={f"old{i}": f"new {i}" for i in range(30)} | {"gone": None})
    kept = spark.createDataFrame([("Gone 1",), ("OTHER 2",), (None,)], "n string").withColumn("name", name).dropna(subset=["name"])
    plan = spark._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "formatted")
    assert plan.count("regexp_replace") <= 4
    assert [r["name"] for r in kept.collect()] == ["other"]


def test_slugs_are_cut_in_one_pass_of_patterns(spark):
    texts = {"  Café -- No. 5!  ": "cafe_no_5", "-a_b\t\n c-": "_a_b_c_", "½ …xﬁ": "12_xfi", "\U0001F600中ß": "", "\x01a\x01 \x1cB\x00": "a_b", "__ __": "_____",
             "¨a": "a", "a\U0001D400…b": "ab", "": "", None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", slugify("t").alias("slug"), ascii_fold("t").alias("folded"))
    got = df.collect()
    assert {r["t"]: r["slug"] for r in got} == texts
    assert {r["folded"] for r in got} >= {"12 ...xfi", "a...b", " a", None}
    plan = spark._jvm.PythonSQLUtils.explainString(df.select("slug")._jdf.queryExecution(), "simple")
    assert plan.count("regexp_replace") == 1 and "(?<=" in plan  # texts are taken apart at folded characters, not at all
