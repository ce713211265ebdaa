"""Set operations and reshaping: stacking, pivoting, encoding, task grids, packing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popgauge.functions.hashing import hash62
from popgauge.operators.joins import attach, running_total


def union_results(parts: Mapping[str, DataFrame], label: str) -> DataFrame:
    """Result sets on top of each other, each row marked with its set's name."""
    marked = [df.withColumn(label, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def except_levels(df: DataFrame, columns: Sequence[str], levels: DataFrame) -> DataFrame:
    """(variable, level) pairs that occur in the columns but are not among the allowed levels."""
    values = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "variable", "level"
    )
    found = values.where(F.col("level").isNotNull()).distinct()
    return found.join(levels.select("variable", "level"), ["variable", "level"], "left_anti")


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def pivot_scores(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per task, one column per model (NULL where the model has no score)."""
    return scores.groupBy("task_id", "task_name", "dataset").pivot("model", list(models)).agg(F.first("score"))


def encode_categoricals(df: DataFrame, levels: Mapping[str, Sequence[str]], *, ordered: Sequence[str] = (),
                        keep: Sequence[str] = ()) -> DataFrame:
    """Two-level columns as 0/1, ordered ones as 1..K, others as one 0/1 column per level.

    ``levels`` gives each column's levels in order; yes/no maps to 1/0 however it is ordered.
    Columns in ``keep`` stay as they are unless they have just two levels. NULL is 0 for two-level
    and dummy columns only where the level is compared; ordered NULL becomes 0 (code -1, plus 1).
    """
    out: list[Column] = []
    dummies: list[Column] = []
    for name in df.columns:
        options = list(levels.get(name, ()))
        x = F.col(name)
        if len(options) < 2 or (len(options) > 2 and name in keep and name not in ordered):
            out.append(x)
        elif len(options) == 2 and set(options) == {"yes", "no"}:
            out.append(F.when(x == "yes", 1).when(x == "no", 0).alias(name))
        elif len(options) == 2:
            out.append(F.when(x == options[0], 0).when(x == options[1], 1).otherwise(-1).alias(name))
        elif name in ordered:
            out.append(F.coalesce(F.array_position(F.array(*[F.lit(o) for o in options]), x), F.lit(0))
                       .cast("int").alias(name))
        else:
            dummies += [F.coalesce(x == o, F.lit(False)).cast("int").alias(f"{name}_{o}") for o in options]
    return df.select(*out, *dummies)


def ordered_levels(df: DataFrame, column: str, order: DataFrame) -> DataFrame:
    """Adds ``ord``, the level's place in the (level, ord) list; levels off the list get NULL."""
    return df.join(order.withColumnRenamed("level", column), column, "left")


def order_custom(value: Column | str, order: Sequence[str]) -> Column:
    """0-based place in a fixed list; -1 when absent."""
    x = F.col(value) if isinstance(value, str) else value
    return (F.array_position(F.array(*[F.lit(o) for o in order]), x) - 1).cast("int")


def task_grid(outcomes: DataFrame, conditions: DataFrame, *, smallest: int = 2, largest: int = 5,
              cap: int | None = None, seed: int = 42) -> DataFrame:
    """Every outcome with every set of ``smallest``..``largest`` conditions.

    ``outcomes`` is (v_out), ``conditions`` (ord, v_cond): variable names, not data. With ``cap``,
    each outcome and size keeps ``cap`` sets in seeded order.
    """
    sets = conditions.select(F.array("v_cond").alias("v_cond"), F.col("ord").alias("top"), F.col("ord").alias("code"))
    grown = [sets]
    for _ in range(1, largest):
        longer = grown[-1].join(
            conditions.select(F.col("v_cond").alias("_next"), "ord"), F.col("top") < F.col("ord")
        )
        grown.append(longer.select(
            F.array_append("v_cond", F.col("_next")).alias("v_cond"), F.col("ord").alias("top"),
            (F.col("code") * 100 + F.col("ord")).alias("code"),
        ))
    sized = reduce(DataFrame.unionByName, grown).withColumn("dim", F.size("v_cond"))
    grid = sized.where(F.col("dim").between(smallest, largest)).join(
        outcomes.select("v_out", F.lit(1).alias("_one")), F.lit(1) == F.col("_one")
    )
    if cap is not None:
        turn = Window.partitionBy("v_out", "dim").orderBy(hash62("code", stream=seed), "code")
        grid = grid.withColumn("_rn", F.row_number().over(turn)).where(F.col("_rn") <= cap)
    return grid.select("v_out", "v_cond", "dim")


def sequence_pack(df: DataFrame, batch: str, order: str, tokens: str, block_size: int = 2048) -> DataFrame:
    """Token lists of a batch run together and cut into full blocks; the tail is dropped.

    ``order`` is numeric and unique in its batch. Offsets come from running totals of the lengths alone, so no task
    orders a whole batch and no window carries tokens. Each list is cut where block boundaries fall, so what moves is
    slices and no block ever holds more than ``block_size`` tokens.
    """
    some = df.where(F.size(tokens) > 0)
    lengths = some.select(batch, order, F.size(tokens).cast("double").alias("_length"))
    offsets = running_total(lengths, [batch], order, ["_length"]).select(
        batch, order, (F.col("cum__length") - F.col("_length")).cast("bigint").alias("_from"))
    placed = attach(some.select(batch, order, tokens), offsets, [batch, order], "inner").select(
        batch, tokens, "_from", (F.col("_from") + F.size(tokens)).alias("_to"))
    first, last = F.floor(F.col("_from") / block_size), F.floor((F.col("_to") - 1) / block_size)
    cut = placed.withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("_from"), F.col("block") * block_size)
    stop = F.least(F.col("_to"), (F.col("block") + 1) * block_size)
    piece = F.slice(tokens, (start - F.col("_from") + 1).cast("int"), (stop - start).cast("int"))
    slices = cut.select(batch, "block", start.alias("_at"), piece.alias("_piece"))
    blocks = slices.groupBy(batch, "block").agg(F.array_sort(F.collect_list(F.struct("_at", "_piece"))).alias("_parts"))
    joined = blocks.select(batch, "block", F.flatten(F.col("_parts._piece")).alias("tokens"))
    return joined.where(F.size("tokens") == block_size)
