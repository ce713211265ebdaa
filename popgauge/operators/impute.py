"""Chained-equation imputation of categorical and numeric columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popgauge.functions.hashing import key_sum, stream_uniform
from popgauge.operators.joins import attach
from popgauge.operators.sampling import level_lines, pick_level
from popgauge.session import cut_lineage

#: Quantiles that a numeric draw can take; each is a value that some row has.
GRID = 1000


def _categorical_draw(df: DataFrame, target: str, seen: Column, by: Sequence[str], u: Column) -> DataFrame:
    """Adds ``_draw``: a level of the target as it is distributed among complete rows of the cell.

    The counts are stored: checking their size and both uses read them instead of the rows.
    """
    counts = cut_lineage(df.where(seen).groupBy(*by, F.col(target).alias("level")).agg(
        F.count(F.lit(1)).cast("double").alias("w")
    ))
    local = attach(df, level_lines(counts, by), by)
    drawn = local.withColumn("_draw", pick_level(u)).drop("_levels", "_upto", "_total")
    everywhere = counts.groupBy("level").agg(F.sum("w").alias("w")).withColumn("_one", F.lit(1))
    overall = level_lines(everywhere, ["_one"])
    whole = attach(drawn.withColumn("_one", F.lit(1)), overall, ["_one"], bounded=True)
    backed = whole.withColumn("_draw", F.coalesce("_draw", pick_level(u)))
    return backed.drop("_levels", "_upto", "_total", "_one")


def _numeric_draw(df: DataFrame, target: str, seen: Column, by: Sequence[str], u: Column) -> DataFrame:
    """Adds ``_draw``: the observed value at the cell's quantile next to ``u``."""
    shares = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])

    def read(grid: str) -> Column:
        return F.element_at(grid, F.floor(u * (GRID + 1)).cast("int") + 1)

    known = df.where(seen)
    local = known.groupBy(*by).agg(F.percentile_approx(target, shares, 10_000).alias("_grid"))
    overall = known.agg(F.percentile_approx(target, shares, 10_000).alias("_all")).withColumn("_one", F.lit(1))
    placed = attach(attach(df, local, by).withColumn("_one", F.lit(1)), overall, ["_one"], bounded=True)
    drawn = placed.withColumn("_draw", F.coalesce(read("_grid"), read("_all")))
    return drawn.drop("_grid", "_all", "_one")


def impute_chained(df: DataFrame, predictors: Mapping[str, Sequence[str]], ids: Sequence[str], *,
                   rounds: int = 5, seed: int = 0) -> DataFrame:
    """One completed table: each column's gaps are drawn given its predictors, column after column,
    round after round.

    A draw follows the distribution among rows that have the column and share the predictors' current
    values; cells without such rows use the whole table. The first pass ("round 0") starts from
    the whole table. Observed values never change. Each round ends in a checkpoint.
    """
    targets = list(predictors)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    work = df.withColumns({f"_gap_{c}": F.col(c).isNull() for c in targets}).withColumn("_keys", key_sum(*ids))
    for r in range(rounds + 1):
        for position, target in enumerate(targets):
            by = list(predictors[target]) if r else []
            u = stream_uniform(F.col("_keys"), seed + r * len(targets) + position)
            seen = ~F.col(f"_gap_{target}")
            draw = _numeric_draw if target in numeric else _categorical_draw
            cells = work.withColumn("_whole", F.lit(1)) if not by else work
            drawn = draw(cells, target, seen, by or ["_whole"], u)
            kind = df.schema[target].dataType
            filled = F.when(F.col(f"_gap_{target}"), F.col("_draw").cast(kind)).otherwise(F.col(target))
            work = drawn.withColumn(target, filled).drop("_draw", "_whole")
        work = cut_lineage(work)
    return work.select(*df.columns)
