"""Distances between weighted distributions and the 0-100 scores built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popgauge.functions.hashing import uniform
from popgauge.operators.joins import attach, running_total

SCORE_GAP = 1e-4


def l1_distance(p: Column | str, q: Column | str) -> Column:
    """Aggregate: sum of absolute differences."""
    left = F.col(p) if isinstance(p, str) else p
    right = F.col(q) if isinstance(q, str) else q
    return F.sum(F.abs(left - right))


def l1_to_uniform(p: Column | str, n_levels: Column | str) -> Column:
    """Aggregate over the levels present: distance to the uniform distribution over all levels.

    Levels that are absent differ by 1/K each, so they need no rows of their own.
    """
    share = F.col(p) if isinstance(p, str) else p
    k = F.max(F.col(n_levels) if isinstance(n_levels, str) else n_levels)
    k_row = F.col(n_levels) if isinstance(n_levels, str) else n_levels
    seen = F.count(F.when(share.isNotNull(), 1))
    return F.sum(F.abs(F.lit(1.0) / k_row - share)) + (k - seen) / k


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Aggregate: weighted mean, NULL without weight."""
    x = F.col(value) if isinstance(value, str) else value
    w = F.col(weight) if isinstance(weight, str) else weight
    return F.try_divide(F.sum(x * w), F.sum(w))


def bench_score(score: Column, worst: Column, best: Column) -> Column:
    """100 at the noise floor, 0 at the naive error, clipped in between."""
    ceiling = F.when(worst < best, best + F.lit(SCORE_GAP)).otherwise(worst)
    share = F.try_divide(score - ceiling, best - ceiling)
    clipped = F.lit(100.0) * F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0))
    return F.when(share.isNotNull(), clipped)


def missing(*values: Column) -> Column:
    """Aggregate: whether any value is NULL or NaN."""
    absent = F.lit(False)
    for v in values:
        absent = absent | v.isNull() | F.isnan(v)
    return F.bool_or(absent)


def weighted_l1(x: Column, y: Column, w: Column) -> Column:
    """Aggregate: weighted mean absolute difference; NULL as soon as any input is missing."""
    mean = F.try_divide(F.sum(F.abs(x - y) * w), F.sum(w))
    return F.when(~missing(x.cast("double"), y.cast("double"), w.cast("double")), mean)


def worst_constant(truth: Column, w: Column) -> Column:
    """Aggregate: error of the best constant guess among 0, 1 and 0.5."""
    guesses = [F.sum(F.abs(truth - F.lit(c)) * w) for c in (0.0, 1.0, 0.5)]
    return F.try_divide(F.least(*guesses), F.sum(w))


def quantile(value: Column | str, share: float = 0.975) -> Column:
    """Aggregate: linearly interpolated quantile. One task holds the distinct values of a group: for replicates
    and other groups whose size is fixed; ``quantiles_by`` takes groups of any size."""
    return F.percentile(value, F.lit(share))


def quantiles_by(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(keys.., q0, q1, ..): linearly interpolated quantiles of each group, exact, from running counts of its
    distinct values; no task holds a whole group."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    curve = running_total(counted, keys, value, ["_n"])

    def at(share: float) -> Column:
        place = F.lit(share) * (F.col("tot__n") - 1)
        low, high = (F.min(F.when(F.col("cum__n") > end, F.col(value))) for end in (F.floor(place), F.ceil(place)))
        part = F.max(place - F.floor(place))
        return low + (high - low) * part

    return curve.groupBy(*keys).agg(*[at(s).alias(f"q{i}") for i, s in enumerate(shares)])


def weighted_corr(df: DataFrame, keys: Sequence[str], x: str, y: str, w: str, *,
                  bounded_keys: bool = False) -> DataFrame:
    """Weighted Pearson correlation per group; 0 when either side is constant.

    Means first, centred moments second: no cancellation for values far from 0. ``bounded_keys``
    says that the keys are spec-sized (models, tasks), which saves counting the means.
    """
    keys = list(keys)
    means = df.groupBy(*keys).agg(
        weighted_mean(x, w).alias("_mx"), weighted_mean(y, w).alias("_my"),
        ((F.min(x) == F.max(x)) | (F.min(y) == F.max(y))).alias("_flat"),
    )
    centred = attach(df, means, keys, bounded=bounded_keys).withColumns(
        {"_dx": F.col(x) - F.col("_mx"), "_dy": F.col(y) - F.col("_my")}
    )
    moments = centred.groupBy(*keys).agg(
        F.sum(F.col(w) * F.col("_dx") * F.col("_dy")).alias("_cov"),
        F.sum(F.col(w) * F.col("_dx") * F.col("_dx")).alias("_vx"),
        F.sum(F.col(w) * F.col("_dy") * F.col("_dy")).alias("_vy"),
        F.first("_flat").alias("_flat"),
    )
    r = F.try_divide(F.col("_cov"), F.sqrt(F.col("_vx") * F.col("_vy")))
    return moments.select(*keys, F.when(F.col("_flat"), 0.0).otherwise(r).alias("correlation"))


def jitter(value: Column, *keys: Column | str, seed: int = 0, width: float = 0.001) -> Column:
    """The value with seeded uniform noise in (-width, width)."""
    return value + (uniform(*keys, stream=seed) * 2 - 1) * F.lit(width)


def cumulative_weights(df: DataFrame, keys: Sequence[str], value: str, side: str, weight: str,
                       sides: tuple[str, str]) -> DataFrame:
    """Weighted distribution functions ``cdf_x`` and ``cdf_y`` of two samples at each distinct value.

    Ties are collapsed before anything is ordered, so equal values never inflate the gap.
    """
    first, second = sides
    ties = df.groupBy(*keys, value).agg(
        F.sum(F.when(F.col(side) == first, F.col(weight)).otherwise(0.0)).alias("wx"),
        F.sum(F.when(F.col(side) == second, F.col(weight)).otherwise(0.0)).alias("wy"),
    )
    summed = running_total(ties, keys, value, ["wx", "wy"])
    return summed.select(
        *keys, value,
        F.try_divide("cum_wx", "tot_wx").alias("cdf_x"), F.try_divide("cum_wy", "tot_wy").alias("cdf_y"),
    )


def ks_weighted(df: DataFrame, keys: Sequence[str], value: str, side: str, weight: str,
                sides: tuple[str, str]) -> DataFrame:
    """Largest gap between the two weighted distribution functions, per group."""
    curve = cumulative_weights(df, keys, value, side, weight, sides)
    return curve.groupBy(*keys).agg(F.max(F.abs(F.col("cdf_x") - F.col("cdf_y"))).alias("ks"))


def scott_bandwidth(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Scott's rule per group: 1.059 A n^(-1/5), A = min(sd, IQR / 1.349), from unweighted spread."""
    stats = df.groupBy(*keys).agg(
        F.stddev_samp(value).alias("_sd"), F.count(value).alias("_n"),
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum(weight).alias("_total"),
    )
    stats = attach(stats, quantiles_by(df, keys, value, (0.25, 0.75)), keys)
    iqr = (F.col("q1") - F.col("q0")) / F.lit(1.349)
    spread = F.when(iqr > 0, F.least("_sd", iqr)).otherwise(F.col("_sd"))
    return stats.withColumn("bw", F.lit(1.059) * spread * F.pow(F.col("_n"), F.lit(-0.2))).drop("q0", "q1", "_sd", "_n")


def kde_weighted(df: DataFrame, keys: Sequence[str], value: str, weight: str, points: int = 64,
                 cut: float = 3.0) -> DataFrame:
    """Weighted Gaussian density on an even grid from min - cut*bw to max + cut*bw, per group.

    Equal values are folded into one kernel first. Each value unfolds into the grid and partial
    aggregation folds it back, so what is shuffled is the grid.
    """
    if not keys:
        one = kde_weighted(df.withColumn("_all", F.lit(0)), ["_all"], value, weight, points, cut)
        return one.drop("_all")
    keys = list(keys)
    known = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    frame = scott_bandwidth(known, keys, value, weight)
    folded = known.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    placed = attach(folded, frame, keys)
    start = F.col("_lo") - F.lit(cut) * F.col("bw")
    width = (F.col("_hi") - F.col("_lo") + F.lit(2 * cut) * F.col("bw")) / F.lit(points - 1)
    grid = placed.select(
        *keys, F.col(value).alias("_v"), "_w", "_total", "bw", start.alias("_start"), width.alias("_width"),
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"),
    )
    x = F.col("_start") + F.col("point") * F.col("_width")
    z = (x - F.col("_v")) / F.col("bw")
    kernel = F.col("_w") / F.col("_total") * F.exp(F.lit(-0.5) * z * z) / (
        F.col("bw") * F.sqrt(F.lit(2.0) * F.pi())
    )
    return grid.select(*keys, "point", x.alias("x"), kernel.alias("_d")).groupBy(*keys, "point", "x").agg(
        F.sum("_d").alias("density")
    )


def calibration_pairs(df: DataFrame, keys: Sequence[str], truth: str, model: str, weight: str) -> DataFrame:
    """Weighted mean of either side per condition: the points of a calibration plot."""
    return df.groupBy(*keys).agg(
        weighted_mean(truth, weight).alias("p_true"), weighted_mean(model, weight).alias("p_mod")
    )


def corr_by_dim(correlations: DataFrame) -> DataFrame:
    """Mean and sample deviation of the per-task correlations by model and dimension."""
    return correlations.groupBy("model", "dim").agg(
        F.avg("correlation").alias("avg_cor"), F.stddev_samp("correlation").alias("sd_cor")
    )


def argmax_first(values: Column | str) -> Column:
    """1-based position of the greatest entry, the first one on ties."""
    x = F.col(values) if isinstance(values, str) else values
    return F.array_position(x, F.array_max(x))


def rank_within(df: DataFrame, value: Column, ties: Sequence[str], name: str = "rank") -> DataFrame:
    """Row number by descending value. For report tables: a few rows per model or dataset."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(value.desc_nulls_last(), *ties)))
