"""P(yes | cell): saturated, out-of-fold, bootstrapped - always on cells, never on respondents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popgauge.functions.hashing import key_sum, poisson_counts
from popgauge.operators.joins import attach, fold_of
from popgauge.operators.metrics import quantile
from popgauge.operators.tabulate import fold_parts, positive
from popgauge.spec import HighDimTask


def distinct_cells(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combinations of condition values that occur; one question each."""
    return df.select(*keys).distinct()


def cell_sums(df: DataFrame, tasks: Sequence[HighDimTask], carry: Sequence[str] = (),
              weight: Column | None = None, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Row count, total and positive weight of every cell: (carry.., task_id, cell, n, w, wy[, ..]).

    Respondents are folded once into the combinations of all variables the tasks use; only those
    combinations are then unfolded into the tasks. Each extra weight ``x`` adds ``x`` and ``xy``.
    """
    extra = dict(extra or {})
    variables = list(dict.fromkeys(v for t in tasks for v in t.variables))
    if weight is None:
        own = {t.weight: f"_w{i}" for i, t in enumerate(tasks)}
        sums = {own[t.weight]: t.weight_value() for t in tasks}
    else:
        own, sums = {}, {"_w": weight}
    finest = df.groupBy(*carry, *variables).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).cast("double").alias(name) for name, c in {**sums, **extra}.items()]
    )
    entries = [
        F.struct(
            F.lit(t.task_id).alias("task_id"), t.cell().alias("cell"), positive(F.col(t.outcome)).alias("y"),
            F.col("_n").alias("n"), F.col(own.get(t.weight, "_w")).alias("w"), *extra,
        )
        for t in tasks
    ]
    rows = finest.select(*carry, F.inline(F.array(*entries))).where(F.col("y").isNotNull())
    totals = [F.sum("n").alias("n")]
    for name in ["w", *extra]:
        totals += [F.sum(name).alias(name), F.sum(F.col(name) * F.col("y")).alias(f"{name}y")]
    return rows.groupBy(*carry, "task_id", "cell").agg(*totals)


def share_positive(sums: DataFrame, *carry: str, weight: str = "w", name: str = "p") -> DataFrame:
    """(carry.., task_id, cell, w, n, p) from cell sums, merged over the splits not in ``carry``."""
    return sums.groupBy(*carry, "task_id", "cell").agg(
        F.sum(weight).alias("w"), F.sum("n").alias("n"),
        F.try_divide(F.sum(f"{weight}y"), F.sum(weight)).alias(name),
    )


def cell_probability(df: DataFrame, tasks: Sequence[HighDimTask], carry: Sequence[str] = (),
                     weight: Column | None = None) -> DataFrame:
    """Weighted share of positives in every cell."""
    sums = cell_sums(df, tasks, carry, weight)
    return sums.select(*carry, "task_id", "cell", "w", "n", F.try_divide("wy", "w").alias("p"))


def join_cells_back(df: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each respondent with the prediction of its cell; NULL condition values match each other."""
    return attach(df, cells, keys)


def mean_baseline(df: DataFrame, tasks: Sequence[HighDimTask]) -> DataFrame:
    """Constant predictor of each task: its unweighted share of positives."""
    counted = cell_sums(df, tasks, weight=F.lit(1.0))
    return counted.groupBy("task_id").agg(F.try_divide(F.sum("wy"), F.sum("w")).alias("q"))


def oof_cell_probability(df: DataFrame, tasks: Sequence[HighDimTask], ids: Sequence[str], *,
                         folds: int = 5, seed: int = 42, min_rows: int = 1) -> DataFrame:
    """P(yes | cell) for each (task, cell, fold), estimated from the other folds only.

    Where the other folds have fewer than ``min_rows`` respondents in the cell, the estimate backs
    off to the cell without its last condition, and so on down to the whole task.
    """
    folded = df.withColumn("fold", fold_of(*ids, folds=folds, seed=seed))
    fine = cell_sums(folded, tasks, ["fold"])
    depths = F.explode(F.sequence(F.lit(0), F.size("cell"))).alias("depth")
    laid = fine.select("*", depths).withColumn("prefix", F.slice("cell", F.lit(1), F.col("depth")))
    own = laid.groupBy("task_id", "depth", "prefix", "fold").agg(
        F.sum("w").alias("w"), F.sum("wy").alias("wy"), F.sum("n").alias("n")
    )
    # At most `folds` rows per group.
    all_folds = Window.partitionBy("task_id", "depth", "prefix")
    others = own.select(
        "task_id", "depth", "prefix", "fold",
        (F.sum("w").over(all_folds) - F.col("w")).alias("ow"),
        (F.sum("wy").over(all_folds) - F.col("wy")).alias("owy"),
        (F.sum("n").over(all_folds) - F.col("n")).alias("on"),
    ).where(F.col("on") >= min_rows)
    found = laid.join(others, ["task_id", "depth", "prefix", "fold"], "left")
    usable = F.when(F.col("ow") > 0, F.col("depth"))
    return found.groupBy("task_id", "cell", "fold").agg(
        F.first("w").alias("w"), F.first("n").alias("n"),
        F.max_by(F.try_divide("owy", "ow"), usable).alias("p"), F.max(usable).alias("depth"),
    )


def replicate_weights(df: DataFrame, tasks: Sequence[HighDimTask], ids: Sequence[str], *, replicates: int = 10,
                      seed: int = 0) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with their Poisson(1) counts, and the weights ``w_c0``, ``w_c1``, .. of the replicates for ``cell_sums``.

    Each respondent counts Poisson(1) times in each replicate, drawn from its own keys, so resampling is a weight
    inside the one aggregation that builds the cells."""
    weights = {t.weight for t in tasks}
    if len(weights) > 1:
        raise ValueError(f"tasks of one bootstrap share one weight, got {sorted(map(str, weights))}")
    keyed = df.withColumn("_keys", key_sum(*ids))
    counted = keyed.withColumn("_counts", poisson_counts(F.col("_keys"), range(seed, seed + replicates)))
    base = tasks[0].weight_value()
    return counted, {f"w_c{b}": base * F.col("_counts")[b] for b in range(replicates)}


def replicated(cells: DataFrame, replicates: int = 10) -> DataFrame:
    """(task_id, cell, w, p, b, p_b) from cell sums with the weights of ``replicate_weights``, summed over whatever
    else splits the cells. A cell that a replicate misses gets the replicate's overall share."""
    names = [f"w_c{b}" for b in range(replicates)]
    sums = cells.groupBy("task_id", "cell").agg(*[F.sum(c).alias(c) for n in ("w", *names) for c in (n, f"{n}y")])
    pairs = F.array(*[
        F.struct(F.lit(b).alias("b"), F.col(n).alias("wb"), F.col(f"{n}y").alias("wyb")) for b, n in enumerate(names)
    ])
    long = sums.select("task_id", "cell", "w", F.try_divide("wy", "w").alias("p"), F.inline(pairs))
    overall = long.groupBy("task_id", "b").agg(F.try_divide(F.sum("wyb"), F.sum("wb")).alias("share"))
    # One row per task and replicate: its size is fixed by the specs.
    joined = attach(long, overall, ["task_id", "b"], bounded=True)
    guess = F.coalesce(F.try_divide("wyb", "wb"), F.col("share"))
    return joined.select("task_id", "cell", "w", "p", "b", guess.alias("p_b"))


def bootstrap_cells(df: DataFrame | Sequence[DataFrame], tasks: Sequence[HighDimTask], ids: Sequence[str], *,
                    replicates: int = 10, seed: int = 0) -> DataFrame:
    """Poisson bootstrap of every cell: (task_id, cell, w, p, b, p_b), all replicates in one scan.

    ``df`` may be a list of the table's parts, which are then folded one after the other."""
    def fold(part: DataFrame) -> DataFrame:
        counted, extra = replicate_weights(part, tasks, ids, replicates=replicates, seed=seed)
        return cell_sums(counted, tasks, extra=extra)

    return replicated(fold(df) if isinstance(df, DataFrame) else fold_parts(df, fold, ["task_id", "cell"]), replicates)


def high_dim_floor(boot: DataFrame, share: float = 0.975) -> DataFrame:
    """Noise floor of each task: high quantile of the weighted L1 between replicate and estimate."""
    per_replicate = boot.groupBy("task_id", "b").agg(
        F.try_divide(F.sum(F.abs(F.col("p_b") - F.col("p")) * F.col("w")), F.sum("w")).alias("l1")
    )
    return per_replicate.groupBy("task_id").agg(quantile("l1", share).alias("best_err"))
