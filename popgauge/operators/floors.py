"""Noise floor of low-dimensional tasks: how far a sample of the same size strays from the truth."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popgauge.functions.hashing import key_sum, text_number, uniform_array
from popgauge.operators.draws import multinomial
from popgauge.operators.metrics import quantile, weighted_mean
from popgauge.operators.tabulate import normalise, scoped
from popgauge.spec import AGGREGATE_DATASETS


def resampled(truth: DataFrame, *, replicates: int = 100, seed: int = 0) -> DataFrame:
    """(task_id, cond, total_weight, b, levels, counts, l1): the level counts of each replicate of each condition, and
    their shares' distance to the true ones.

    Resampling n respondents with chances proportional to weight and counting their levels is a multinomial draw of n
    with the levels' shares, which is what is drawn, exactly: whole counts that sum to n, at a cost that depends on the
    levels and the square root of n, never on the respondents. The draws are keyed by task, condition, level and
    replicate. A condition is one record, as long as its question has levels; records are spread over all tasks.
    """
    spark = truth.sparkSession
    shares = normalise(scoped(truth), ["task_id", "cond"])
    whole = Window.partitionBy("task_id", "cond")  # the levels of one question
    cells = shares.select(
        "task_id", "cond", "level", "p", F.sum("n").over(whole).alias("n"), F.sum("w").over(whole).alias("total_weight"),
        key_sum("task_id", text_number("cond"), text_number("level")).alias("key"),
    ).where((F.col("n") > 0) & (F.col("total_weight") > 0))
    records = cells.groupBy("task_id", "cond").agg(
        F.array_sort(F.collect_list(F.struct("level", "p", "key"))).alias("cells"), F.first("n").alias("n"), F.first("total_weight").alias("total_weight"),
    ).select("task_id", "cond", "total_weight", "n", F.col("cells.level").alias("levels"), F.col("cells.p").alias("p"), F.col("cells.key").alias("keys"))
    spread = records.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "task_id", "cond")

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                p = np.asarray(row.p, float)
                counts = multinomial(int(row.n), p, uniform_array(np.asarray(row.keys), range(seed, seed + replicates)))
                yield pd.DataFrame({
                    "task_id": row.task_id, "cond": row.cond, "total_weight": row.total_weight, "b": np.arange(replicates, dtype=np.int32),
                    "levels": [row.levels] * replicates, "counts": list(counts.T), "l1": np.abs(counts / row.n - p[:, None]).sum(axis=0),
                })

    return spread.mapInPandas(draw, "task_id int, cond string, total_weight double, b int, levels array<string>, counts array<bigint>, l1 double")


def bootstrap_errors(truth: DataFrame, *, replicates: int = 100, seed: int = 0) -> DataFrame:
    """L1 between resampled and true distribution: (task_id, cond, total_weight, b, l1)."""
    return resampled(truth, replicates=replicates, seed=seed).select("task_id", "cond", "total_weight", "b", "l1")


def bootstrap_floor(truth: DataFrame, tasks: DataFrame, *, replicates: int = 100, share: float = 0.975,
                    seed: int = 0) -> DataFrame:
    """(task_id, best_err): quantile over replicates of the condition-weighted error.

    Tables of counts have no sampling noise: their floor is 0 and nothing is drawn for them.
    """
    kinds = tasks.select("task_id", F.col("dataset").isin(*AGGREGATE_DATASETS).alias("counts"))
    sampled = truth.join(F.broadcast(kinds.where(~F.col("counts"))), "task_id", "left_semi")
    errors = bootstrap_errors(sampled, replicates=replicates, seed=seed)
    return floor_from_errors(errors, share).unionByName(
        kinds.where("counts").select("task_id", F.lit(0.0).alias("best_err"))
    )


def floor_from_errors(errors: DataFrame, share: float = 0.975) -> DataFrame:
    """(task_id, best_err) from (task_id, cond, total_weight, b, l1)."""
    per_replicate = errors.groupBy("task_id", "b").agg(weighted_mean("l1", "total_weight").alias("l1"))
    return per_replicate.groupBy("task_id").agg(quantile("l1", share).alias("best_err"))


def missing_floors(tasks: DataFrame, store: DataFrame, identity: Sequence[str] = ("task_id",)) -> DataFrame:
    """Tasks whose floor is not in the store yet."""
    return tasks.join(store.select(*identity), list(identity), "left_anti")
