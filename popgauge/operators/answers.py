"""From raw answers of the respondent under test to level weights."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popgauge.functions.hashing import key_sum, stream_uniform
from popgauge.functions.text import parse_letter, parse_prob_bin, probability_bins
from popgauge.operators.metrics import argmax_first

MAX_PERMUTATIONS = 128
ROUNDING = 1e-9


def mc_vote_distribution(answers: DataFrame, keys: Sequence[str], text: str, options: str) -> DataFrame:
    """Sampled answers as weights: one vote per answer for the level its letter stands for.

    Letters outside the options vote for the NULL level.
    """
    votes = answers.select(*keys, parse_letter(text, options).alias("level"))
    return votes.groupBy(*keys, "level").agg(F.count(F.lit(1)).cast("double").alias("w"))


def letter_masses(answers: DataFrame, keys: Sequence[str], permutation: str, shown: str, masses: str) -> DataFrame:
    """Mass of every level in every order: (keys.., permutation, level, mass), 0 for a level whose letter got none.

    ``shown`` has the levels in the order shown, lettered A, B, ..; ``masses`` maps answer tokens to their mass. Tokens that
    are a letter but for blanks around it count for that letter's level; all others are no answer."""
    letter = lambda i: F.char(F.lit(65) + i)
    said = F.map_entries(masses)
    levels = F.transform(shown, lambda level, i: F.struct(level.alias("level"), F.aggregate(
        F.filter(said, lambda e: F.trim(e["key"]) == letter(i)), F.lit(0.0), lambda total, e: total + e["value"]).alias("mass")))
    return answers.select(*keys, permutation, F.inline(levels))


def permutation_average(masses: DataFrame, keys: Sequence[str], permutation: str, level: str, mass: str) -> DataFrame:
    """Mean probability of each level over the option orders its prompt was shown in; a prompt's means sum to 1.

    Mass is normalised within each prompt and order; an order that got no mass at all counts as uniform over the prompt's
    levels, and a level without a row in an order has probability 0 there. Orders count, not rows."""
    orders = masses.groupBy(*keys, permutation).agg(F.sum(mass).alias("_total"))
    shown = orders.groupBy(*keys).agg(F.count(F.lit(1)).alias("_orders"), F.count_if(F.coalesce("_total", F.lit(0.0)) == 0).alias("_empty"))
    total = F.sum(mass).over(Window.partitionBy(*keys, permutation))  # the options of one prompt
    share = F.when(total != 0, F.coalesce(F.col(mass), F.lit(0.0)) / total).otherwise(0.0)
    sums = masses.withColumn("_p", share).groupBy(*keys, level).agg(F.sum("_p").alias("_p"))
    counted = sums.withColumn("_options", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return counted.join(shown, list(keys)).select(
        *keys, level, ((F.col("_p") + F.col("_empty") / F.col("_options")) / F.col("_orders")).alias("p"))


def mean_logprob(tokens: DataFrame, keys: Sequence[str], prompt: str, logprob: str) -> DataFrame:
    """Mean over a task's prompts of the mean log-probability of each prompt's tokens."""
    per_prompt = tokens.groupBy(*keys, prompt).agg(F.avg(logprob).alias("_lp"))
    return per_prompt.groupBy(*keys).agg(F.avg("_lp").alias("mean_logprob"))


def argmax_decode(values: Column | str, labels: Column | str) -> Column:
    """Label of the greatest entry, the first one on ties."""
    options = F.col(labels) if isinstance(labels, str) else labels
    return F.element_at(options, argmax_first(values).cast("int"))


def decode_prob_matrix(df: DataFrame, keys: Sequence[str], order: str, probs: str, bins: Column) -> DataFrame:
    """Level weights from one probability question per level: the likeliest bin's midpoint each.

    The last level is not asked; it gets what is left of 1, and ``is_valid`` tells if that is >= 0.
    """
    ask = Window.partitionBy(*keys)
    last = F.col(order) == F.max(order).over(ask)
    decoded = df.withColumn("_last", last).withColumn(
        "_w", F.when(~F.col("_last"), parse_prob_bin(argmax_decode(probs, bins)))
    )
    rest = F.lit(1.0) - F.coalesce(F.sum("_w").over(ask), F.lit(0.0))
    weight = F.when(F.col("_last"), rest).otherwise(F.col("_w"))
    return decoded.withColumns({"weight": weight, "is_valid": rest >= -ROUNDING}).drop("_last", "_w")


def budget_levels(answers: Column | str) -> Column:
    """Fold over a prompt's answers in question order; each answer is an array of bin probabilities.

    An answer picks the likeliest of the bins still offered; the pick's index is taken off the upper
    end of the next offer. Returns (``offered``, ``picked``): bins on offer and 0-based pick of every
    answer, the last one (which is not asked) left out. No bins left means no question: NULL.
    """
    x = F.col(answers) if isinstance(answers, str) else answers
    asked = F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0)))
    nothing = F.array().cast("array<int>")
    start = F.struct(
        F.lit(len(probability_bins())).alias("left"), nothing.alias("offered"), nothing.alias("picked")
    )

    def step(state: Column, probs: Column) -> Column:
        left = state["left"]
        pick = F.when(left > 0, (argmax_first(F.slice(probs, F.lit(1), left)) - 1).cast("int"))
        return F.struct(
            (left - F.coalesce(pick, F.lit(0))).alias("left"),
            F.array_append(state["offered"], left).alias("offered"),
            F.array_append(state["picked"], pick).alias("picked"),
        )

    return F.aggregate(asked, start, step, lambda s: F.struct(s["offered"].alias("offered"), s["picked"].alias("picked")))


def prompt_permutations(prompts: DataFrame, levels: str, *ids: str, limit: int = MAX_PERMUTATIONS,
                        seed: int = 0) -> DataFrame:
    """Orders in which a prompt's options are shown: all K! when at most ``limit``, else ``limit``
    seeded random ones. Adds ``permutation`` (0-based) and ``shown``.

    All orders are read off their number, digit by digit in the factorial base, so a prompt unfolds
    into its orders directly.
    """
    k = F.size(levels)
    most = max(i for i in range(1, 27) if math.factorial(i) <= limit)
    every = k <= most
    count = F.when(every, F.factorial(k).cast("int")).otherwise(F.lit(limit))
    numbered = prompts.withColumn("permutation", F.explode(F.sequence(F.lit(0), count - 1))).withColumn(
        "_keys", key_sum(*ids, "permutation"))
    pairs = F.transform(levels, lambda x, i: F.struct(stream_uniform(F.col("_keys"), i + seed).alias("u"), x.alias("x")))
    shuffled = F.transform(F.array_sort(pairs), lambda e: e["x"])

    def take(state: Column, place: Column) -> Column:
        # Options left in their order; the digit at this place says which comes next.
        remaining = F.size(state["left"])
        block = F.factorial(remaining - 1)
        digit = F.floor(state["number"] / block).cast("int")
        return F.struct(
            (state["number"] - digit * block).alias("number"),
            F.filter(state["left"], lambda _, i: i != digit).alias("left"),
            F.array_append(state["shown"], F.element_at(state["left"], digit + 1)).alias("shown"),
        )

    start = F.struct(
        F.col("permutation").cast("bigint").alias("number"), F.col(levels).alias("left"),
        F.slice(levels, 1, 0).alias("shown"),
    )
    ordered = F.aggregate(F.sequence(F.lit(1), k), start, take, lambda s: s["shown"])
    return numbered.withColumn("shown", F.when(every, ordered).otherwise(shuffled)).drop("_keys")


Scorer = Callable[[pd.DataFrame], pd.Series]


def score_batch(prompts: DataFrame, scorer: Scorer, output: str, output_type: str = "double") -> DataFrame:
    """Prompts with the scorer's answer; the scorer sees one Arrow batch of rows at a time.

    Batch size is ``spark.sql.execution.arrow.maxRecordsPerBatch``. The scorer runs in the tasks
    that hold the prompts; nothing passes the driver.
    """
    columns = prompts.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{output: scorer(batch)})[[*columns, output]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.mapInPandas(run, f"{fields}, `{output}` {output_type}")


def reference_as_model(cells: DataFrame, model: str, prompting: str = "QA") -> DataFrame:
    """A second table in the role of the model: its task cells are the answers."""
    return cells.where(F.col("cond").isNotNull() & F.col("w").isNotNull()).select(
        F.lit(model).alias("model"), F.lit(prompting).alias("prompting"), "task_id", "cond", "level", "w"
    )
