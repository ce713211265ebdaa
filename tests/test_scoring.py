"""Golden vectors, score properties and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from popgauge.operators import metrics as M
from popgauge.operators.cells import cell_probability, oof_cell_probability
from popgauge.operators.floors import bootstrap_errors, bootstrap_floor
from popgauge.operators.tabulate import scoped, task_cells, weighted_distribution
from popgauge.plans.scoring import detail_table, eval_high_dim, eval_low_dim
from popgauge.spec import HighDimTask, LowDimTask, Subset, task_frame

CELLS = "task_id int, cond string, level string, w double, n bigint"
ANSWERS = "model string, prompting string, task_id int, cond string, level string, w double"


def golden(spark):
    truth = {"a": (60, [.5, .3, .2]), "b": (40, [.1, .1, .8])}
    model = {"a": [.4, .4, .2], "b": [.3, .3, .4]}
    cells = [(1, c, f"l{i}", w * p, 10) for c, (w, ps) in truth.items() for i, p in enumerate(ps)]
    said = [("m", "QA", 1, c, f"l{i}", q) for c, qs in model.items() for i, q in enumerate(qs)]
    return spark.createDataFrame(cells, CELLS), spark.createDataFrame(said, ANSWERS)


def test_low_dim_golden(spark):
    truth, answers = golden(spark)
    floors = spark.createDataFrame([(1, 0.05)], "task_id int, best_err double")
    row = eval_low_dim(truth, answers, floors).first()
    assert row.score == pytest.approx(0.44)
    assert row.worst == pytest.approx(0.5733333333333)
    assert row.bench == pytest.approx(25.477707006369)


def test_high_dim_golden(spark):
    truth = spark.createDataFrame(
        [(1, [str(i)], w, p) for i, (w, p) in enumerate(zip([1., 2., 1., 4.], [.2, .6, .9, .5]))],
        "task_id int, cell array<string>, w double, p double")
    said = spark.createDataFrame(
        [("m", "QA", 1, [str(i)], q) for i, q in enumerate([.25, .5, .7, .5])],
        "model string, prompting string, task_id int, cell array<string>, q double")
    floors = spark.createDataFrame([(1, 0.01)], "task_id int, best_err double")
    row = eval_high_dim(truth, said, floors).first()
    assert (row.score, row.worst) == (pytest.approx(0.05625), pytest.approx(0.1125))
    assert row.bench == pytest.approx(54.878048780488)


def test_missing_cell_gives_null_score(spark):
    truth = spark.createDataFrame([(1, ["a"], 1., .2), (1, ["b"], 1., .4)], "task_id int, cell array<string>, w double, p double")
    said = spark.createDataFrame([("m", "QA", 1, ["a"], .2)], "model string, prompting string, task_id int, cell array<string>, q double")
    row = eval_high_dim(truth, said).first()
    assert row.score is None and row.bench is None


def test_perfect_answer_scores_100_and_weights_scale_out(spark):
    truth, _ = golden(spark)
    same = truth.select(F.lit("m").alias("model"), F.lit("QA").alias("prompting"), "task_id", "cond", "level", (F.col("w") * 7).alias("w"))
    assert eval_low_dim(truth, same).first().bench == pytest.approx(100.0)
    scaled = truth.withColumn("w", F.col("w") * 1000)
    _, answers = golden(spark)
    assert eval_low_dim(scaled, answers).first().score == pytest.approx(0.44)


def test_unknown_answers_strict_and_renormalised(spark):
    truth, answers = golden(spark)
    junk = spark.createDataFrame([("m", "QA", 1, "a", "gibberish", 1.0), ("m", "QA", 1, "b", None, 1.0)], ANSWERS)
    mixed = answers.unionByName(junk)
    assert eval_low_dim(truth, mixed).first().bench is None
    row = eval_low_dim(truth, mixed, strict=False).first()
    assert row.score == pytest.approx(0.44)
    assert row.unparsed_share == pytest.approx(0.5)


def test_worst_below_best_is_lifted(spark):
    df = spark.createDataFrame([(0.3, 0.1, 0.2), (0.1, 0.1, 0.2)], "s double, worst double, best double")
    out = [r[0] for r in df.select(M.bench_score(F.col("s"), F.col("worst"), F.col("best"))).collect()]
    assert out == [0.0, 100.0]


def test_levels_come_from_the_whole_table(spark):
    df = spark.createDataFrame(
        [("x", "c", 20, 1.0), ("y", "c", 30, 1.0), ("z", "c", 5, 1.0), (None, "c", 40, 1.0), ("x", None, 40, 1.0)],
        "out string, by string, age int, weight double")
    task = LowDimTask(1, "t", "acs", "out", "by", subset=Subset("age", at_least=18))
    truth = task_cells(df, [task])
    assert {r.level for r in scoped(truth).collect()} == {"x", "y"}
    said = spark.createDataFrame([("m", "QA", 1, "c", "x", 1.0), ("m", "QA", 1, "c", "y", 1.0)], ANSWERS)
    # Three levels count in the uniform error although one of them is outside the subset.
    assert eval_low_dim(truth, said).first().worst == pytest.approx(2 * abs(1 / 3 - 1 / 2) + 1 / 3)


def test_detail_table_sums_to_one(spark):
    truth, answers = golden(spark)
    levels = spark.createDataFrame([(1, f"l{i}", i + 1) for i in range(3)], "task_id int, level string, ord int")
    sums = detail_table(truth, answers, levels).groupBy("cond", "type").agg(F.sum("prop").alias("s")).collect()
    assert len(sums) == 4 and all(r.s == pytest.approx(1) for r in sums)


def test_distribution_sums_to_one(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("v"), (F.col("id") % 5).alias("weight"))
    for row in weighted_distribution(df, ["k"], "v").groupBy("k").agg(F.sum("p").alias("s")).collect():
        assert row.s == pytest.approx(1)


def test_weighted_corr_golden_and_constant(spark):
    rows = list(zip([.2, .6, .9, .5], [.25, .5, .7, .5], [1., 2., 1., 4.]))
    df = spark.createDataFrame([("a", *r) for r in rows] + [("b", 1.0, r[1], r[2]) for r in rows], "k string, x double, y double, w double")
    out = {r.k: r.correlation for r in M.weighted_corr(df, ["k"], "x", "y", "w").collect()}
    assert out["a"] == pytest.approx(0.964749744934) and out["b"] == 0.0


def test_weighted_l1_null_rule(spark):
    df = spark.createDataFrame([(1, .1, .2, 1.), (1, .3, .1, 3.), (2, .1, None, 1.), (3, .1, float("nan"), 1.)], "k int, x double, y double, w double")
    out = {r.k: r.v for r in df.groupBy("k").agg(M.weighted_l1(F.col("x"), F.col("y"), F.col("w")).alias("v")).collect()}
    assert out[1] == pytest.approx(0.7 / 4) and out[2] is None and out[3] is None


def test_ks_matches_brute_force_and_is_symmetric(spark):
    rows = [("x", float(i * i % 17), 1.0 + i % 3) for i in range(60)] + [("y", float(i * 5 % 23), 1.0 + i % 2) for i in range(50)]
    df = spark.createDataFrame([("all", *r) for r in rows], "k string, g string, v double, w double")
    got = M.ks_weighted(df, ["k"], "v", "g", "w", ("x", "y")).first().ks
    back = M.ks_weighted(df, ["k"], "v", "g", "w", ("y", "x")).first().ks

    def cdf(side, at):
        total = sum(w for g, _, w in rows if g == side)
        return sum(w for g, v, w in rows if g == side and v <= at) / total

    want = max(abs(cdf("x", v) - cdf("y", v)) for _, v, _ in rows)
    assert got == pytest.approx(want) and back == pytest.approx(want) and got <= 1


def test_kde_integrates_to_one(spark):
    df = spark.range(200).select((F.col("id") % 23).cast("double").alias("v"), F.lit(1.0).alias("w"))
    points = sorted((r.x, r.density) for r in M.kde_weighted(df, [], "v", "w", points=200).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(1, abs=0.01)


def test_bootstrap_error_matches_theory_and_falls_with_n(spark):
    def cells(n):
        return spark.createDataFrame([(1, "c", lv, p * n, round(p * n)) for lv, p in (("a", .5), ("b", .3), ("c", .2))], CELLS)

    def mean(n):
        return bootstrap_errors(cells(n), replicates=400, seed=3).agg(F.avg("l1")).first()[0]

    want = sum(math.sqrt(2 * p * (1 - p) / (math.pi * 1000)) for p in (.5, .3, .2))
    assert mean(1000) == pytest.approx(want, rel=0.1)
    assert mean(100_000) < mean(1000) / 5


def test_bootstrap_floor_is_repeatable_and_zero_for_counts(spark):
    cells = spark.createDataFrame([(t, c, lv, 10.0, 10) for t in (1, 2) for c in "xy" for lv in "abc"], CELLS)
    tasks = task_frame(spark, [LowDimTask(1, "s", "acs", "o", "c"), LowDimTask(2, "n", "labor", "o", "c")])
    first = {r.task_id: r.best_err for r in bootstrap_floor(cells, tasks).collect()}
    again = {r.task_id: r.best_err for r in bootstrap_floor(cells.repartition(3), tasks).collect()}
    assert first == again and first[2] == 0.0 and 0 < first[1] < 1


def test_cells_keep_null_conditions_apart(spark):
    df = spark.createDataFrame([("yes", "a", None, 1.0), ("no", "a", None, 3.0), ("Yes", "a", "b", 2.0), (None, "a", "b", 9.0)],
                               "y string, c string, d string, weight double")
    out = {tuple(r.cell): r.p for r in cell_probability(df, [HighDimTask(1, "x", "y", ("c", "d"))]).collect()}
    assert out == {("a", None): pytest.approx(0.25), ("a", "b"): 1.0}


def test_out_of_fold_uses_other_folds_only(spark):
    rows = [(i, "yes" if i % 3 == 0 else "no", f"c{i % 4}", "d", 1.0 + i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, y string, c string, d string, weight double")
    from popgauge.operators.joins import fold_of

    folds = {r.id: r.fold for r in df.select("id", fold_of("id").alias("fold")).collect()}
    out = oof_cell_probability(df, [HighDimTask(1, "x", "y", ("c", "d"))], ["id"]).collect()
    for r in out:
        others = [(y, w) for i, y, c, _, w in rows if c == r.cell[0] and folds[i] != r.fold]
        assert r.p == pytest.approx(sum(w for y, w in others if y == "yes") / sum(w for _, w in others))


def test_boosting_agrees_with_dense_cells(spark):
    from popgauge.operators.boosting import oof_boosted

    rows = [(i, "yes" if (i * 7919) % 100 < (10, 30, 50, 80)[i % 4] else "no", f"c{i % 4}", f"d{i % 2}", 1.0) for i in range(8000)]
    df = spark.createDataFrame(rows, "id int, y string, c string, d string, weight double")
    task = HighDimTask(1, "x", "y", ("c", "d"))
    cells = {tuple(r.cell): r.p for r in cell_probability(df, [task]).collect()}
    out = oof_boosted(df, task, ["id"], folds=2).collect()
    assert sum(r.w for r in out) == pytest.approx(8000)
    assert all(r.p == pytest.approx(cells[r.c, r.d], abs=0.08) for r in out)


def answers_of(spark, *rows):
    return spark.createDataFrame([("m", "QA", 1, *r) for r in rows], "model string, prompting string, task_id int, cond string, level string, w double")


def test_an_unanswered_condition_is_not_left_out(spark):
    truth = spark.createDataFrame([(1, c, lv, w, 10) for c in "xy" for lv, w in (("a", 30.0), ("b", 70.0))], CELLS)
    half = answers_of(spark, ("x", "a", 3.0), ("x", "b", 7.0), ("nowhere", "a", 1.0))
    strict, lenient = (eval_low_dim(truth, half, strict=s).first() for s in (True, False))
    assert strict.score is None and strict.bench is None and strict.unanswered_share == 0.5
    assert lenient.score == pytest.approx(0.0) and lenient.worst == strict.worst == pytest.approx(0.4)


def test_floors_stored_twice_count_once(spark, tmp_path):
    from popgauge.sources.files import store_floors

    floors = spark.createDataFrame([(1, 0.05), (2, 0.1)], "task_id int, best_err double")
    path = str(tmp_path / "floors")
    store_floors(floors, path)
    store_floors(floors.where("task_id = 1"), path)
    store = spark.read.parquet(path)
    assert sorted((r.task_id, r.best_err) for r in store.collect()) == [(1, 0.05), (2, 0.1)]
    truth = spark.createDataFrame([(1, "x", lv, w, 10) for lv, w in (("a", 30.0), ("b", 70.0))], CELLS)
    twice = eval_low_dim(truth, answers_of(spark, ("x", "a", 3.0), ("x", "b", 7.0)), floors.unionByName(floors))
    assert twice.count() == 1
