"""Exact resampling counts, and the store of floors."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from popgauge.operators.draws import binomial, multinomial
from popgauge.operators.floors import bootstrap_floor, resampled
from popgauge.sources.floorstore import FloorStore, fingerprints
from popgauge.spec import LowDimTask, task_frame

CELLS = "task_id int, cond string, level string, w double, n long"


def law(n, p):
    """Distribution function of the binomial in exact arithmetic."""
    q, total, out = Fraction(p).limit_denominator(10 ** 6), Fraction(0), []
    for k in range(n + 1):
        total += math.comb(n, k) * q ** k * (1 - q) ** (n - k)
        out.append(total)
    return out


@pytest.mark.parametrize("n", [5, 30, 1000])
@pytest.mark.parametrize("p", [0.001, 0.2, 0.5, 0.973])
def test_counts_are_inverses_of_the_exact_law(n, p):
    u = np.concatenate([np.linspace(0.0005, 0.9995, 400), [1e-12, 1 - 1e-12]])
    steps = [float(s) for s in law(n, p)]
    want = [next(k for k, s in enumerate(steps) if s >= x) for x in u]
    assert binomial(np.full(len(u), n), p, u).tolist() == want


def test_counts_of_many_trials_have_mean_and_spread():
    u = (np.arange(20_000) + 0.5) / 20_000
    for n, p in ((10 ** 6, 0.3), (10 ** 9, 1e-8), (10 ** 11, 0.4)):
        some = u if n < 10 ** 11 else u[::2_000]
        got = binomial(np.full(len(some), n), p, some)
        sd = math.sqrt(n * p * (1 - p))
        assert abs(np.median(got) - n * p) < max(2, 0.2 * sd)
        if len(some) > 1_000:
            assert got.std() == pytest.approx(sd, rel=0.02)


def test_edges():
    assert binomial(np.array([0, 7]), 0.5, np.array([0.3, 1e-18])).tolist() == [0, 0]
    assert binomial(np.array([4, 4]), 0.0, np.array([0.3, 0.9])).tolist() == [0, 0]
    assert binomial(np.array([4, 4]), 1.0, np.array([0.3, 0.9])).tolist() == [4, 4]


def test_multinomial_follows_its_law():
    r = np.random.default_rng(0)
    n, p = 6, np.array([0.5, 0.2, 0.0, 0.3])
    counts = multinomial(n, p, r.random((4, 60_000)))
    assert (counts.sum(axis=0) == n).all() and (counts[2] == 0).all() and counts.min() == 0
    for a in range(n + 1):
        for b in range(n + 1 - a):
            want = math.comb(n, a) * math.comb(n - a, b) * 0.5 ** a * 0.2 ** b * 0.3 ** (n - a - b)
            assert ((counts[0] == a) & (counts[1] == b)).mean() == pytest.approx(want, abs=5 * math.sqrt(want / 60_000) + 1e-3)


def test_resampled_counts_sum_to_the_respondents(spark):
    truth = spark.createDataFrame([(1, c, lv, w, n) for c, n in (("x", 5), ("y", 300)) for lv, w in (("a", 1.5), ("b", 3.0), ("z", 0.0))], CELLS)
    rows = resampled(truth, replicates=30).collect()
    assert len(rows) == 60
    for r in rows:
        total = 15 if r.cond == "x" else 900
        assert sum(r["counts"]) == total and list(r.levels) == ["a", "b", "z"] and r["counts"][2] == 0
        assert r.l1 == pytest.approx(sum(abs(c / total - p) for c, p in zip(r["counts"], (1 / 3, 2 / 3, 0))))
    again = {(r.cond, r.b): tuple(r["counts"]) for r in resampled(truth.repartition(5), replicates=30).collect()}
    assert again == {(r.cond, r.b): tuple(r["counts"]) for r in rows}


TASKS = [LowDimTask(1, "s", "acs", "o", "c"), LowDimTask(2, "t", "gss", "o", "c"), LowDimTask(3, "n", "labor", "o", "c")]


def test_store_draws_only_what_is_missing_or_changed(spark, tmp_path):
    store, calls = FloorStore(spark, f"file://{tmp_path}/floors"), []

    def cells(second=10.0):
        return spark.createDataFrame([(t, c, lv, second if t == 2 else 10.0, 10) for t in (1, 2, 3) for c in "xy" for lv in "abc"], CELLS)

    def floors(truth):
        def draw(ids):
            calls.append(ids)
            return bootstrap_floor(truth.where(F.col("task_id").isin(ids)), task_frame(spark, [t for t in TASKS if t.task_id in ids]))
        return {r.task_id: r.best_err for r in store.floors(fingerprints(truth, ["cond", "level"], ["w", "n"]), draw).collect()}

    first = floors(cells())
    assert calls == [[1, 2, 3]] and first[3] == 0.0 and first[1] > 0
    assert floors(cells().repartition(7)) == first and len(calls) == 1
    changed = cells().where("NOT (task_id = 2 AND level = 'c')")
    again = floors(changed)
    assert calls[1:] == [[2]] and again[1] == first[1] and again[2] != first[2]
    assert len(store.commits()) == 2


def test_unfinished_additions_are_not_read(spark, tmp_path):
    store = FloorStore(spark, f"file://{tmp_path}/floors")
    store.add(spark.createDataFrame([(1, "f", 0.5)], "task_id int, fingerprint string, best_err double"))
    store.add(spark.createDataFrame([(2, "f", 0.25)], "task_id int, fingerprint string, best_err double"))
    (next(p for p in (tmp_path / "floors").iterdir() if spark.read.parquet(f"file://{p}").first().task_id == 2) / "_SUCCESS").unlink()
    assert [tuple(r) for r in store.read().collect()] == [(1, "f", 0.5)]
    assert FloorStore(spark, f"file://{tmp_path}/none").read().count() == 0
