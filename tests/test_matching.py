"""Imputation by regression and matching, against numpy."""

import random

import numpy as np
import pytest

from popgauge.operators import matching as M


def rows_of(n=1500, seed=4):
    r, out = random.Random(seed), []
    for i in range(n):
        kind, x = r.choice(["a", "b", "c"]), r.gauss(0, 1)
        y = 10 + 4 * x + {"a": 0, "b": 20, "c": -15}[kind] + r.gauss(0, 0.5)
        answer = "yes" if x + r.gauss(0, 0.3) > 0 else "no"
        out.append((i, kind, x, None if i % 9 == 0 else y, None if i % 7 == 0 else answer, round(100 * x) if i % 11 else None))
    return out


SCHEMA = "id int, kind string, x double, y double, answer string, cents int"
COLUMNS = ["kind", "x", "y", "answer", "cents"]


def test_fills_follow_all_other_columns(spark):
    rows = rows_of()
    out = {r.id: r for r in M.impute_matched(spark.createDataFrame(rows, SCHEMA).repartition(4), COLUMNS, ["id"], rounds=2).collect()}
    assert len(out) == len(rows)
    known = [{r[k] for r in rows if r[k] is not None} for k in range(6)]
    for r in rows:
        new = tuple(out[r[0]])
        for k, (before, after) in enumerate(zip(r, new)):
            if before is not None:
                assert after == before
            else:
                assert after is not None and min(abs(after - v) for v in known[k]) < 1e-9 if k in (3, 5) else after in known[k]
    gaps = [r for r in rows if r[3] is None]
    wrong = [out[r[0]].y - (10 + 4 * r[2] + {"a": 0, "b": 20, "c": -15}[r[1]]) for r in gaps]
    assert np.abs(np.median(wrong)) < 0.3 and np.percentile(np.abs(wrong), 90) < 2.0
    told = [(out[r[0]].answer == "yes") == (r[2] > 0) for r in rows if r[4] is None and abs(r[2]) > 1]
    assert sum(told) > 0.8 * len(told)
    assert np.corrcoef([r[2] for r in rows if r[5] is None], [out[r[0]].cents for r in rows if r[5] is None])[0, 1] > 0.99


def test_coefficients_are_least_squares(spark):
    rows = [r for r in rows_of(400) if None not in r]
    df = spark.createDataFrame(rows, SCHEMA)
    encoding = M.Encoding(df, COLUMNS)
    frame = df.select(*[encoding.value(c).alias(c) for c in COLUMNS])
    beta = M.coefficients(M._products(frame.repartition(5), encoding), encoding.place["y"])
    levels = encoding.levels
    x = np.array([[1, *(r[1] == v for v in levels["kind"]), r[2], *(r[4] == v for v in levels["answer"]), r[5]] for r in rows], float)
    y = np.array([r[3] for r in rows])
    fit = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    mine = np.concatenate([encoding.matrix(b) for b in frame.toArrow().to_batches()]) @ beta
    assert np.sort(mine[:, 0] * encoding.scale["y"] + encoding.mean["y"]) == pytest.approx(np.sort(fit), abs=0.02)


@pytest.mark.parametrize("bucket", [10_000, 40])
def test_nearest_donors_match_brute_force(spark, bucket):
    r = random.Random(8)
    donors = [(r.choice([r.gauss(0, 1), 0.5, 0.5]), float(i)) for i in range(700)]
    gaps = [(i, r.gauss(0, 1.2), r.random()) for i in range(200)]
    got = {x.row: x.value for x in M.nearest_donors(spark.createDataFrame(donors, "pred double, value double"), spark.createDataFrame(gaps, "row bigint, pred double, u double"), 5, bucket).collect()}
    assert len(got) == 200
    pred = {v: p for p, v in donors}
    for row, at, _ in gaps:
        limit = sorted(abs(p - at) for p, _ in donors)[4]
        assert abs(pred[got[row]] - at) <= limit + (1e-12 if bucket > 1000 else 0.2)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, None), (3, None, 4.0)], "id int, never string, y double")
    out = {r.id: r for r in M.impute_matched(df, ["never", "y"], ["id"], rounds=1).collect()}
    assert all(r.never is None for r in out.values()) and out[2].y in (2.0, 4.0)
    assert M.impute_matched(df.where("id > 9"), ["never", "y"], ["id"], rounds=1).count() == 0
    whole = spark.createDataFrame([(1, "a", 2.0)], "id int, k string, y double")
    assert M.impute_matched(whole, ["k", "y"], ["id"], rounds=1).collect() == whole.collect()
