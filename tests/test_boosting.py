"""Boosting with sums made by Spark."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from popgauge.operators import boosting as B
from popgauge.operators.cells import oof_cell_probability
from popgauge.spec import HighDimTask


def people(n=8000, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        c, d, x = r.randrange(4), r.randrange(3), r.gauss(0, 1)
        chance = 1 / (1 + math.exp(-(c - 1.5 + (1.5 if c == 2 and d == 1 else 0) - (d == 2))))
        rows.append((i, "yes" if r.random() < chance else "no", "yes" if r.random() < 1 / (1 + math.exp(-2 * x * abs(x))) else "no",
                     None if r.random() < 0.02 else f"c{c}", f"d{d}", x, r.choice([0.5, 1.0, 3.0])))
    return rows


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(people(), "id int, y string, z string, c string, d string, x double, weight double").repartition(3)


TASK = HighDimTask(1, "x", "y", ("c", "d"))


def loss(rows, truth):
    return sum(-wy * math.log(p) - (w - wy) * math.log(1 - p) for p, w, wy in ((p, *truth[k]) for k, p in rows.items())) / sum(w for w, _ in truth.values())


def test_held_out_loss_is_near_that_of_a_saturated_fit(spark, df):
    from popgauge.operators.joins import fold_of

    sums = df.groupBy(F.coalesce("c", F.lit(B.UNKNOWN)).alias("c"), "d", fold_of("id").alias("fold")).agg(
        F.sum("weight").alias("w"), F.sum(F.when(F.col("y") == "yes", F.col("weight")).otherwise(0)).alias("wy")).collect()
    truth = {(r.c, r.d, r.fold): (r.w, r.wy) for r in sums}
    got = {(r.c, r.d, r.fold): r.p for r in B.oof_boosted(df, TASK, ["id"]).collect()}
    full = {(r.cell[0] or B.UNKNOWN, r.cell[1], r.fold): min(max(r.p, 1e-3), 1 - 1e-3) for r in oof_cell_probability(df, [TASK], ["id"]).collect()}
    assert got.keys() == truth.keys() == full.keys()
    share = sum(wy for _, wy in truth.values()) / sum(w for w, _ in truth.values())
    constant = loss(dict.fromkeys(truth, share), truth)
    assert loss(got, truth) < loss(full, truth) + 0.002 < constant - 0.05
    assert max(abs(got[k] - full[k]) for k in got if truth[k][0] > 150) < 0.1


def test_numeric_conditions_are_binned(spark, df):
    out = B.oof_boosted(df, HighDimTask(2, "x", "z", ("x",)), ["id"]).collect()
    assert len({r.x for r in out}) <= B.CUTS + 2
    last = {}
    for r in out:
        last.setdefault(r.x.split(":")[0], []).append(r.p)
    means = [np.mean(last[k]) for k in sorted(last) if k != B.UNKNOWN]
    assert means[0] < 0.1 and means[-1] > 0.9 and means == sorted(means, key=lambda m: round(m, 1))


def test_jobs_do_not_depend_on_tasks_and_replicates(spark, df):
    few = B.training_cells(df, [TASK], ["id"], folds=2, seed=42)
    many = B.training_cells(df, [TASK, HighDimTask(2, "x", "z", ("x", "d")), HighDimTask(3, "x", "y", ("d",), None)], ["id"], folds=4, seed=42, replicates=3)
    for cells in (few, many):
        models, best, jobs = B.fitted(cells, rounds=3, patience=9)
        assert jobs == 1 + 4 + 3 * (B.DEPTH - 1)
    assert [len(m.fits) for m in models] == [12, 12, 12]


def test_trees_from_sums_equal_trees_from_rows(spark, df):
    """A split chosen from Spark's sums is the best one over the rows themselves, by brute force on the first node."""
    cells = B.training_cells(df, [TASK], ["id"], folds=2, seed=42)
    models, _, _ = B.fitted(cells, rounds=1, patience=5)
    rows = cells.read().toPandas()
    for f, (b, held) in enumerate(models[0].fits):
        train = rows[rows["fold"] != held]
        w = np.array([x[b] for x in train["w"]]) * models[0].scale[f]
        p = 1 / (1 + np.exp(-models[0].start[f]))
        g, h = (p - train["y"]) * w, p * (1 - p) * w
        codes = np.array(train["codes"].tolist())

        def score(mask):
            return g[mask].sum() ** 2 / (h[mask].sum() + B.PENALTY) + g[~mask].sum() ** 2 / (h[~mask].sum() + B.PENALTY)

        best = max(score(np.isin(codes[:, c], [v for v in range(8) if bits >> v & 1])) for c in range(2) for bits in range(1, 256)
                   if 0 < np.isin(codes[:, c], [v for v in range(8) if bits >> v & 1]).sum() < len(codes))
        condition, left, _ = models[0].rounds[0]
        chosen = left[f, 0][codes[:, condition[f, 0]]]
        assert score(chosen) == pytest.approx(best)


def test_rare_values_share_a_code(spark, monkeypatch):
    monkeypatch.setattr(B, "BINS", 3)
    df = spark.createDataFrame([(i, "yes" if i % 7 == 0 else "no", f"v{min(i % 11, 6)}", 1.0) for i in range(700)], "id int, y string, c string, weight double")
    cells = B.training_cells(df, [HighDimTask(1, "x", "y", ("c",))], ["id"], folds=2, seed=1)
    assert cells.sizes == [[4]]
    assert {(r.cell[0] in ("v6", "v0", "v1"), r.codes[0] > 0) for r in cells.read().collect()} == {(True, True), (False, False)}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id int, y string, c string, weight double")
    assert B.boosted(empty, [HighDimTask(1, "x", "y", ("c",))], ["id"]).count() == 0
