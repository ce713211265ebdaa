"""From cells to scores, for all models, promptings and tasks in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popgauge.operators.metrics import (
    bench_score, weighted_l1, weighted_mean, worst_constant,
)
from popgauge.operators.tabulate import level_sets, normalise, scoped

RUN = ["model", "prompting"]


def _weight_of(entries: Column, level: Column) -> Column:
    """Weight of a level in an array of (level, w)."""
    return F.aggregate(
        F.filter(entries, lambda e: e["level"] == level), F.lit(0.0), lambda total, e: total + e["w"]
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def condition_errors(truth: DataFrame, answers: DataFrame, *, strict: bool = True) -> DataFrame:
    """Per (model, prompting, task, condition): L1 to the truth, L1 of uniform, condition weight.

    ``truth`` holds task cells, ``answers`` (model, prompting, task_id, cond, level, w). A run is asked
    every condition that the truth knows; the error of one it did not answer is NULL. An answer that
    is none of the task's levels (or NULL) makes the error NULL when ``strict``; otherwise it is left
    out and its weight reported as ``unparsed_share``.

    Either side becomes one record per condition, its weights lined up along the task's levels, so
    the two sides meet in a single join of condition records.
    """
    levels = level_sets(truth)
    entries = F.collect_list(F.struct("level", "w"))
    real = scoped(truth).groupBy("task_id", "cond").agg(
        entries.alias("_true"), F.sum("w").alias("cond_weight")
    )
    judged = answers.join(levels, "task_id").withColumn(
        "_known", F.coalesce(F.array_contains("levels", F.col("level")), F.lit(False))
    )
    said = judged.groupBy(*RUN, "task_id", "cond").agg(
        F.collect_list(F.when(F.col("_known"), F.struct("level", "w"))).alias("_said"),
        F.sum(F.when(F.col("_known"), F.col("w"))).alias("_valid"),
        F.sum("w").alias("_answered"),
        F.sum(F.when(~F.col("_known"), F.col("w")).otherwise(0.0)).alias("_unknown"),
    )
    asked = answers.select(*RUN, "task_id").distinct().join(real, "task_id").join(levels, "task_id")
    p = lambda level: _weight_of(F.col("_true"), level) / F.col("cond_weight")
    q = lambda level: _weight_of(F.col("_said"), level) / F.col("_valid")
    gap = F.when((F.col("_valid") != 0) & (F.col("cond_weight") != 0), _total(F.transform("levels", lambda x: F.abs(p(x) - q(x)))))
    even = F.lit(1.0) / F.size("levels")
    flat = F.when(F.col("cond_weight") != 0, _total(F.transform("levels", lambda x: F.abs(even - p(x)))))
    errors = asked.join(said, [*RUN, "task_id", "cond"], "left").select(
        *RUN, "task_id", "cond", gap.alias("score"), flat.alias("worst"), "cond_weight",
        F.try_divide("_unknown", "_answered").alias("unparsed_share"),
    )
    if strict:
        errors = errors.withColumn("score", F.when(F.col("unparsed_share") == 0, F.col("score")))
    return errors


def eval_low_dim(truth: DataFrame, answers: DataFrame, floors: DataFrame | None = None, *,
                 strict: bool = True) -> DataFrame:
    """Error, naive error, noise floor and bench score per (model, prompting, task).

    ``floors`` is (task_id, best_err); tasks without one have floor 0. A condition without a score
    makes the run's score NULL when ``strict``; otherwise the mean is over the others and
    ``unanswered_share`` tells the weight of those left out.
    """
    errors = condition_errors(truth, answers, strict=strict)
    missing = F.col("score").isNull()
    scored = F.when(~missing, F.col("cond_weight"))
    mean = F.try_divide(F.sum(F.col("score") * scored), F.sum(scored))
    runs = errors.groupBy(*RUN, "task_id").agg(
        (F.when(~F.bool_or(missing), mean) if strict else mean).alias("score"),
        weighted_mean("worst", "cond_weight").alias("worst"),
        F.max("unparsed_share").alias("unparsed_share"),
        F.try_divide(F.sum(F.when(missing, F.col("cond_weight")).otherwise(0.0)), F.sum("cond_weight")).alias("unanswered_share"),
    )
    return with_bench(runs, floors)


def with_bench(runs: DataFrame, floors: DataFrame | None) -> DataFrame:
    if floors is None:
        runs = runs.withColumn("best", F.lit(0.0))
    else:
        known = floors.groupBy("task_id").agg(F.max("best_err").alias("best"))
        runs = runs.join(known, "task_id", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return runs.withColumn("bench", bench_score(F.col("score"), F.col("worst"), F.col("best")))


def eval_high_dim(truth: DataFrame, answers: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """Scores of P(yes | cell) predictions, computed on cells instead of respondents.

    ``truth`` is (task_id, cell, w, p), ``answers`` (model, prompting, task_id, cell, q). All
    respondents of a cell share both predictions, so weighting cells by their total weight gives the
    respondent-level metric exactly. A cell without an answer makes the score NULL.
    """
    runs = answers.select(*RUN, "task_id").distinct()
    asked = truth.join(runs, "task_id").join(answers, [*RUN, "task_id", "cell"], "left")
    scored = asked.groupBy(*RUN, "task_id").agg(
        weighted_l1(F.col("q"), F.col("p"), F.col("w")).alias("score"),
        worst_constant(F.col("p"), F.col("w")).alias("worst"),
    )
    return with_bench(scored, floors)


def score_table(tasks: DataFrame, *evaluations: DataFrame) -> DataFrame:
    """Benchmark table: one row per model, prompting and task; failed runs keep a NULL score."""
    columns = [*RUN, "task_id", "bench"]
    stacked = evaluations[0].select(*columns)
    for more in evaluations[1:]:
        stacked = stacked.unionByName(more.select(*columns))
    facts = tasks.select("task_id", "name", "dataset", "dim")
    return stacked.join(facts, "task_id").select(
        "model", "task_id", F.coalesce("name", F.col("task_id").cast("string")).alias("task_name"),
        "dataset", "dim", F.col("bench").alias("score"), (F.col("prompting") == "Likelihood").alias("prob"),
    )


def detail_table(truth: DataFrame, answers: DataFrame, levels: DataFrame) -> DataFrame:
    """Reality and Model shares of every level of every answered condition, in level order.

    ``levels`` is (task_id, level, ord).
    """
    answered = answers.select(*RUN, "task_id", "cond").distinct()
    spine = answered.join(levels, "task_id")
    real = normalise(scoped(truth), ["task_id", "cond"]).select("task_id", "cond", "level", "p")
    run = [*RUN, "task_id", "cond"]
    said = normalise(answers.groupBy(*run, "level").agg(F.sum("w").alias("w")), run, name="q").select(*run, "level", "q")
    wide = spine.join(real, ["task_id", "cond", "level"], "left").join(said, [*run, "level"], "left")
    sides = F.array(
        F.struct(F.lit("Reality").alias("type"), F.coalesce("p", F.lit(0.0)).alias("prop")),
        F.struct(F.lit("Model").alias("type"), F.coalesce("q", F.lit(0.0)).alias("prop")),
    )
    return wide.select(*run, (F.col("ord") - 1).alias("lvl"), F.col("level").alias("lvl_names"), F.inline(sides))
