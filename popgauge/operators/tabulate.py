"""Weighted tabulation: from respondents to (task, condition, level) cells.

Everything downstream works on these cells. They come from one scan: each row is unfolded into
the tasks it takes part in, and partial aggregation folds it back before anything is shuffled,
so the shuffle carries cells, never respondents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popgauge.session import cut_lineage
from popgauge.spec import POSITIVE_ANSWERS, HighDimTask, LowDimTask

CELL = ["task_id", "cond", "level"]


def weighted_tabulate(df: DataFrame, keys: Sequence[str], level: str, weight: str | None = "weight") -> DataFrame:
    """Total weight ``w`` and row count ``n`` of each level within the keys; NULL levels drop out."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return (
        df.where(F.col(level).isNotNull())
        .groupBy(*keys, level)
        .agg(F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"))
    )


def normalise(cells: DataFrame, keys: Sequence[str], weight: str = "w", name: str = "p") -> DataFrame:
    """Share of each row in its group's weight; groups without weight get NULL."""
    total = F.sum(weight).over(Window.partitionBy(*keys))
    return cells.withColumn(name, F.when(total != 0, F.col(weight) / total))


def weighted_distribution(df: DataFrame, keys: Sequence[str], level: str, weight: str | None = "weight") -> DataFrame:
    return normalise(weighted_tabulate(df, keys, level, weight), keys)


def unfold_tasks(df: DataFrame, tasks: Sequence[LowDimTask], carry: Sequence[str] = (),
                 weight: Column | None = None, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per respondent and task: (carry.., task_id, cond, level, w[, extra weights..]).

    ``cond`` is NULL for rows outside the task's subset or range: they count towards its levels,
    not its distributions. NULL outcomes drop out.
    """
    entries = []
    for task in tasks:
        scope = task.in_scope()
        more = [F.when(scope, column.cast("double")).alias(name) for name, column in (extra or {}).items()]
        entries.append(F.struct(
            F.lit(task.task_id).alias("task_id"),
            F.when(scope, task.condition_value()).alias("cond"),
            F.col(task.outcome).cast("string").alias("level"),
            F.when(scope, task.weight_value() if weight is None else weight).alias("w"),
            *more,
        ))
    return df.select(*carry, F.inline(F.array(*entries))).where(F.col("level").isNotNull())


def task_cells(df: DataFrame, tasks: Sequence[LowDimTask], carry: Sequence[str] = (),
               weight: Column | None = None, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Weight and count of every (task, condition, level), all tasks of a table in one scan.

    ``extra`` sums further weights over the same cells, ``carry`` splits the cells by more columns.
    """
    return (
        unfold_tasks(df, tasks, carry, weight, extra)
        .groupBy(*carry, *CELL)
        .agg(F.sum("w").alias("w"), F.count("w").alias("n"), *[F.sum(c).alias(c) for c in extra or {}])
    )


def merge_cells(cells: DataFrame, *carry: str, weight: str = "w") -> DataFrame:
    """Cells without the splits that are not in ``carry``; ``weight`` becomes the weight ``w``."""
    return cells.groupBy(*carry, *CELL).agg(F.sum(weight).alias("w"), F.sum("n").alias("n"))


def fold_parts(parts: Iterable[DataFrame], fold: Callable[[DataFrame], DataFrame], keys: Sequence[str]) -> DataFrame:
    """Cells of a table that comes in parts. ``fold`` makes a part's cells, sums by ``keys``; they are checkpointed.

    The parts run one after the other and each one's shuffled files are deleted when its cells stand, so the disk holds
    the rows of one part at a time. A cell that several parts have is summed up at the end."""
    cells = [cut_lineage(fold(part), release=True) for part in parts]
    if len(cells) == 1:
        return cells[0]
    sums = [F.sum(c).alias(c) for c in cells[0].columns if c not in keys]
    stacked = reduce(DataFrame.unionByName, cells)
    return cut_lineage(stacked.groupBy(*keys).agg(*sums).select(*cells[0].columns), release=True)


def task_levels(cells: DataFrame) -> DataFrame:
    """Levels of each task over its whole table."""
    return cells.select("task_id", "level").distinct()


def level_sets(cells: DataFrame) -> DataFrame:
    """(task_id, levels): the ordered options of each task's question."""
    return cells.groupBy("task_id").agg(F.array_sort(F.collect_set("level")).alias("levels"))


def level_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("task_id").agg(F.count_distinct("level").alias("n_levels"))


def scoped(cells: DataFrame) -> DataFrame:
    """Cells that belong to a condition; conditions without any weight drop out."""
    return cells.where(F.col("cond").isNotNull() & F.col("w").isNotNull())


def align_levels(cells: DataFrame, levels: DataFrame, keys: Sequence[str] = ("task_id", "cond")) -> DataFrame:
    """Every condition with every level of its task, weight 0 where unseen."""
    spine = cells.select(*keys).distinct().join(levels, "task_id")
    filled = spine.join(cells.select(*keys, "level", "w"), [*keys, "level"], "left")
    return filled.withColumn("w", F.coalesce("w", F.lit(0.0)))


def ground_truth(cells: DataFrame) -> DataFrame:
    """Result record of a condition: values and weights as arrays, row count, total weight.

    The arrays hold the levels of one question, not respondents.
    """
    entries = F.array_sort(F.collect_list(F.struct("level", "w")))
    return (
        scoped(cells)
        .groupBy("task_id", "cond")
        .agg(entries.alias("entries"), F.sum("n").alias("n_data"), F.sum("w").alias("total_weight"))
        .select(
            "task_id", F.col("cond").alias("condition"),
            F.col("entries.level").alias("true_vals"), F.col("entries.w").alias("true_weights"),
            "n_data", "total_weight",
        )
    )


def flatten_results(records: DataFrame, values: str, weights: str, side: str) -> DataFrame:
    """Result arrays back to long rows."""
    zipped = F.arrays_zip(F.col(values).alias("level"), F.col(weights).alias("w"))
    kept = [c for c in ("model", "prompting", "task_id") if c in records.columns]
    return records.select(
        *kept, F.col("condition").alias("cond"), F.lit(side).alias("side"), F.inline(zipped)
    )


def positive(outcome: Column) -> Column:
    return F.when(outcome.isNotNull(), outcome.isin(*POSITIVE_ANSWERS).cast("double"))


def split_counts(df: DataFrame, category: str, shares: Sequence[str], counts: Sequence[str],
                 share_name: str = "sex", count_name: str = "race") -> DataFrame:
    """Joint cells from two margins under independence: each count times each share."""
    sides = [
        F.struct(F.lit(s).alias(share_name), F.lit(c).alias(count_name), (F.col(c) * F.col(s)).alias("weight"))
        for c in counts for s in shares
    ]
    return df.select(category, F.inline(F.array(*sides)))


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per cent NULL of each column, from one aggregation."""
    rates = df.agg(*[(100 * F.avg(F.col(c).isNull().cast("double"))).alias(c) for c in columns])
    return rates.unpivot([], list(columns), "column", "pct_null")


def task_size_high_dim(df: DataFrame, tasks: Sequence[HighDimTask]) -> DataFrame:
    """Number of distinct condition cells of each task (NULL is a value), and its dimension."""
    entries = [F.struct(F.lit(t.task_id).alias("task_id"), F.lit(t.dim).alias("dim"), t.cell().alias("cell"))
               for t in tasks]
    cells = df.select(F.inline(F.array(*entries))).distinct()
    return cells.groupBy("task_id", "dim").agg(F.count(F.lit(1)).alias("size"))


def task_size_low_dim(df: DataFrame, tasks: Sequence[LowDimTask]) -> DataFrame:
    """(outcome levels - 1) x (conditions), with NULL counted as a value on either side."""
    entries = [
        F.struct(F.lit(t.task_id).alias("task_id"), F.lit(axis).alias("axis"), column.cast("string").alias("value"))
        for t in tasks
        for axis, column in (("out", F.col(t.outcome)), ("cond", t.condition_value()))
    ]
    seen = df.select(F.inline(F.array(*entries))).distinct()
    sides = seen.groupBy("task_id").agg(
        F.count_if(F.col("axis") == "out").alias("k_out"), F.count_if(F.col("axis") == "cond").alias("k_cond")
    )
    return sides.select("task_id", ((F.col("k_out") - 1) * F.col("k_cond")).alias("size"))
