"""Report tables: roll-ups of the score table (model, task_id, task_name, dataset, dim, score, prob).

A score table has one row per model, prompting and task, so these run on a few thousand rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popgauge.functions.recode import name_or_self, recode_map
from popgauge.operators.metrics import rank_within
from popgauge.operators.reshape import order_custom
from popgauge.plans.names import (
    DATASET_NAMES, DOMAIN_ORDER, DOMAINS, MODEL_NAMES, MODEL_SIZES, SENSITIVE_VARIABLES,
)

TUNED = "(_instruct|_chat)"


def mean_score(scores: DataFrame, *keys: str) -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg("score").alias("score"))


def display_model(model: Column | str) -> Column:
    return name_or_self(model, MODEL_NAMES)


def prompting_label(prob: str = "prob", qa: str = "QA") -> Column:
    return F.when(F.col(prob), "Likelihood").otherwise(qa)


def leaderboard(scores: DataFrame) -> DataFrame:
    """Mean score by model, rounded half to even, best first."""
    means = mean_score(scores, "model").withColumn("model_display", display_model("model"))
    ranked = rank_within(means, F.col("score"), ["model"])
    return ranked.withColumn("score", F.bround("score").cast("int"))


def setting_label(dim: str = "dim") -> Column:
    return F.when(F.col(dim) > 1, "High-Dimensional").otherwise("Low-Dimensional")


def leaderboard_setting(scores: DataFrame) -> DataFrame:
    """Mean score by model for the four settings: low/high dimension, QA/likelihood."""
    labelled = scores.withColumns({"setting": setting_label(), "prompting": prompting_label()})
    return mean_score(labelled, "model", "setting", "prompting").withColumn("lab", F.bround("score").cast("int"))


def by_dataset(scores: DataFrame) -> DataFrame:
    """Mean score by model, dataset and prompting, with the dataset's place by mean of means."""
    means = mean_score(scores, "model", "dataset", "prob")
    order = rank_within(mean_score(means, "dataset"), F.col("score"), ["dataset"], "dataset_rank")
    named = means.join(order.select("dataset", "dataset_rank"), "dataset")
    return named.withColumns({
        "dataset": recode_map("dataset", DATASET_NAMES), "model_display": display_model("model"),
        "prompting": prompting_label(),
    })


def order_by_group_mean(scores: DataFrame, group: str, *within: str) -> DataFrame:
    """Groups ordered by the mean of their cells' mean scores."""
    means = mean_score(scores, group, *within)
    return rank_within(mean_score(means, group), F.col("score"), [group])


def by_domain(scores: DataFrame) -> DataFrame:
    """Mean score by model and dataset, placed on one axis: domain, then model, then dataset.

    ``x_pos`` is the 0-based place, ``domain_start``/``domain_end`` the extent of the domain.
    """
    means = mean_score(scores, "model", "dataset").withColumns({
        "dataset": recode_map("dataset", DATASET_NAMES), "model_display": display_model("model"),
    })
    named = means.withColumn("domain", recode_map("dataset", DOMAINS)).where(F.col("domain").isNotNull())
    axis = Window.orderBy(order_custom("domain", DOMAIN_ORDER), "model_display", "dataset", "model")
    placed = named.withColumn("x_pos", F.row_number().over(axis) - 1)
    extent = Window.partitionBy("domain")
    return placed.withColumns({
        "x": F.concat("model_display", F.lit(" | "), "dataset"),
        "domain_start": F.min("x_pos").over(extent), "domain_end": F.max("x_pos").over(extent) + 1,
    })


def by_dimension(scores: DataFrame) -> DataFrame:
    means = mean_score(scores, "model", "dim", "prob")
    return means.withColumns({
        "model_display": display_model("model"), "dimension": F.concat(F.lit("d = "), F.col("dim").cast("string")),
    })


def by_size(scores: DataFrame, sizes: dict[str, float] | None = None) -> DataFrame:
    """Mean score against parameter count (billions)."""
    known = MODEL_SIZES if sizes is None else sizes
    return mean_score(scores, "model").withColumn("size", recode_map("model", known).cast("double"))


def by_prompting(scores: DataFrame, baseline: DataFrame) -> DataFrame:
    """Mean score by model and prompting, next to the mean score of the constant predictor."""
    means = mean_score(scores, "model", "prob").withColumn("prompting", prompting_label())
    floor = baseline.agg(F.avg("score").alias("baseline")).withColumn("_one", F.lit(1))
    return means.withColumn("_one", F.lit(1)).join(F.broadcast(floor), "_one").drop("_one")


def variant_columns(model: Column | str) -> dict[str, Column]:
    """Family name of a model and whether it is an instruction-tuned variant."""
    x = F.col(model) if isinstance(model, str) else model
    return {"family": F.regexp_replace(x, TUNED, ""), "tuned": x.rlike(TUNED)}


def base_vs_tuned(scores: DataFrame) -> DataFrame:
    """Mean score of the base and tuned variant of each model family."""
    return mean_score(scores.withColumns(variant_columns("model")), "family", "tuned")


def is_sensitive(variables: Column | str, sensitive: Sequence[str] = SENSITIVE_VARIABLES) -> Column:
    x = F.col(variables) if isinstance(variables, str) else variables
    return F.arrays_overlap(x, F.array(*[F.lit(v) for v in sensitive]))


def fairness_split(scores: DataFrame, task_variables: DataFrame,
                   sensitive: Sequence[str] = SENSITIVE_VARIABLES) -> DataFrame:
    """Mean score by model, prompting and whether the task touches a sensitive variable."""
    flags = task_variables.select("task_id", is_sensitive("variables", sensitive).alias("sensitive"))
    marked = scores.join(flags, "task_id")
    return mean_score(marked, "model", "prob", "sensitive")


def tuning_effect(scores: DataFrame, before: str, after: str, dataset: str) -> DataFrame:
    """Score of each task of a dataset before and after tuning."""
    label = F.when(F.col("model") == before, "before").when(F.col("model") == after, "after")
    picked = scores.where((F.col("dataset") == dataset) & F.col("model").isin(before, after))
    staged = picked.withColumns({"stage": label, "setting": setting_label(), "prompting": prompting_label(qa="Q&A")})
    staged = staged.groupBy("task_id", "task_name", "setting", "prompting")
    return staged.pivot("stage", ["before", "after"]).agg(F.first("score"))


def heatmap_long(scores: DataFrame) -> DataFrame:
    """Every task score, with the model's place by mean score."""
    order = rank_within(mean_score(scores, "model"), F.col("score"), ["model"], "model_rank")
    return scores.select("model", "task_id", "prob", "score").join(order.select("model", "model_rank"), "model")


def memorisation_scatter(logprobs: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean log-probability against score per model and task, with padded axis bounds."""
    points = logprobs.join(scores.select("model", "task_id", "prob", "dim", "score"), ["model", "task_id"])
    pad_y, pad_x = 5.0, 0.1
    bounds = points.agg(
        F.greatest(F.lit(0.0), F.min("score") - pad_y).alias("y_min"),
        F.least(F.lit(100.0), F.max("score") + pad_y).alias("y_max"),
        (F.min("mean_logprob") - pad_x).alias("x_min"), (F.max("mean_logprob") + pad_x).alias("x_max"),
    ).withColumn("_one", F.lit(1))
    return points.withColumns({"kind": setting_label(), "_one": F.lit(1)}).join(F.broadcast(bounds), "_one").drop("_one")


def dashboard_filter(scores: DataFrame, prob: bool, datasets: Sequence[str], dims: Sequence[int],
                     model: str | None = None) -> DataFrame:
    """Rows a dashboard selection shows; rows without a dimension pass the dimension filter."""
    keep = (F.col("prob") == prob) & F.col("dataset").isin(*datasets)
    keep = keep & (F.col("dim").isNull() | F.col("dim").isin(*dims))
    return scores.where(keep if model is None else keep & (F.col("model") == model))


def explorer_ranking(scores: DataFrame, prob: bool, datasets: Sequence[str], dims: Sequence[int]) -> DataFrame:
    """Models by mean score over the selected rows, best first."""
    shown = dashboard_filter(scores, prob, datasets, dims).withColumn("model_display", display_model("model"))
    return rank_within(mean_score(shown, "model_display"), F.col("score"), ["model_display"])


def small_tasks(scores: DataFrame, sizes: DataFrame, most: int = 250) -> DataFrame:
    """Scores of tasks that ask at most ``most`` questions."""
    return scores.join(sizes.where(F.col("size") <= most).select("task_id", "size"), "task_id")


def zero_score_tasks(scores: DataFrame, sizes: DataFrame, model: str, most: int = 150) -> DataFrame:
    """Tasks of bounded size on which a model scores exactly 0."""
    zero = scores.where((F.col("model") == model) & (F.col("score") == 0.0))
    return small_tasks(zero, sizes, most)


def min_loss_epoch(history: DataFrame, *runs: str) -> DataFrame:
    """Early-stopping epoch (least evaluation loss, the first on ties) and greatest loss of each run.

    ``history`` is (runs.., epoch, kind, loss_value) with kind Training or Evaluation.
    """
    judged = F.when(F.col("kind") == "Evaluation", F.struct("loss_value", "epoch"))
    return history.groupBy(*runs).agg(
        F.min(judged).alias("_best"), F.max("loss_value").alias("y_top")
    ).select(*runs, F.col("_best.epoch").alias("epoch"), "y_top", (F.col("y_top") * 0.6).alias("y"))


def score_export(scores: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Scores with display names, ready for the web export."""
    named = scores
    if titles is not None:
        named = scores.join(titles, "task_id", "left").withColumn("task_name", F.coalesce("title", "task_name"))
    return named.select(
        "model", "task_id", "task_name", recode_map("dataset", DATASET_NAMES).alias("dataset"), "dim", "score",
        prompting_label(qa="Q&A").alias("prob"), display_model("model").alias("model_display"),
    )
