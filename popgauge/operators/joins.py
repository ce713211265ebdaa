"""Joins whose small side is checked before it is broadcast, and whose hot keys are split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popgauge.functions.hashing import hash62
from popgauge.session import cut_lineage


def attach(facts: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left", *, bounded: bool = False) -> DataFrame:
    """Join each fact to its (at most one) lookup row; NULL keys match NULL keys.

    The join is left to adaptive execution, which knows the lookup's bytes when it runs: it broadcasts a small one
    and splits the facts of a hot key otherwise. ``bounded`` asks for the broadcast where the lookup's size is fixed
    by the task specs.
    """
    renamed = lookup.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [facts[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys])
    return facts.join(F.broadcast(renamed) if bounded else renamed, match, how).drop(*[f"_k_{k}" for k in keys])


def lookup_last(codes: DataFrame, key: str, order: str) -> DataFrame:
    """One row per code: the last one listed. Blank codes are left out."""
    values = [c for c in codes.columns if c not in (key, order)]
    return (
        codes.withColumn(key, F.trim(F.col(key).cast("string")))
        .where(F.col(key).isNotNull() & ~F.col(key).isin("", "nan"))
        .groupBy(key)
        .agg(*[F.max_by(c, order).alias(c) for c in values])
    )


def lookup_default(df: DataFrame, codes: DataFrame, on: Mapping[str, str], order: str,
                   default: str = "") -> DataFrame:
    """Names of a code from a code list; ``default`` where the list lacks the code."""
    (fact_key, code_key), = on.items()
    table = lookup_last(codes, code_key, order).withColumnRenamed(code_key, fact_key)
    named = attach(df, table, [fact_key])
    values = [c for c in table.columns if c != fact_key]
    return named.withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c in values})


def merge_by_id(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Component tables side by side, one row per id that occurs in any of them.

    The tables are stacked and folded by id in one shuffle, however many they are. A column comes from the one table that
    has it (of several the first); an id that occurs twice in a table is an error, as its rows would be mixed."""
    numbered = [t.select(F.col(key), F.lit(i).alias("_table"), F.struct(*[c for c in t.columns if c != key]).alias(f"_row{i}")) for i, t in enumerate(tables)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    counts = [F.count_if(F.col("_table") == i) for i in range(len(tables))]
    folded = stacked.groupBy(key).agg(
        F.greatest(*counts, F.lit(0)).alias("_most"), *[F.any_value(f"_row{i}", ignoreNulls=True).alias(f"_row{i}") for i in range(len(tables))])
    columns = dict.fromkeys(c for t in tables for c in t.columns if c != key)
    sources = {c: [F.col(f"_row{i}")[c] for i, t in enumerate(tables) if c in t.columns] for c in columns}
    sound = F.when(F.col("_most") > 1, F.raise_error(F.concat(F.lit("id occurs twice in a table: "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return folded.where(sound).select(key, *[F.coalesce(*found).alias(c) for c, found in sources.items()])


def self_variants(scores: DataFrame, keys: Sequence[str], tuned: str, value: str = "score") -> DataFrame:
    """Untuned and tuned score of the same thing side by side."""
    base = scores.where(~F.col(tuned)).select(*keys, F.col(value).alias(f"{value}_x"))
    other = scores.where(F.col(tuned)).select(*keys, F.col(value).alias(f"{value}_y"))
    return base.join(other, list(keys))


def audit(annotated: DataFrame, truth: DataFrame, key: str, variables: Sequence[str]) -> DataFrame:
    """Cells whose annotation differs from the labelled truth (NULL-safe)."""
    def cells(df: DataFrame, name: str) -> DataFrame:
        texts = df.select(key, *[F.col(v).cast("string").alias(v) for v in variables])
        return texts.unpivot([key], list(variables), "variable", name)

    pairs = cells(truth, "true_value").join(cells(annotated, "pred_value"), [key, "variable"])
    return pairs.where(~F.col("true_value").eqNullSafe(F.col("pred_value")))


def already_done(todo: DataFrame, done: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Work items whose full identity is not among the finished ones."""
    return todo.join(done.select(*identity), list(identity), "left_anti")


def equal_depth(df: DataFrame, keys: Sequence[str], order: str, side: int = 16) -> DataFrame:
    """``df`` with ``_bucket``: its place among the ``side * side`` quantile ranges of its group.

    The bounds come from a mergeable quantile sketch of each group, so that buckets are about equally full however the
    values are spread. A sketch depends on the order in which parts were merged; its bounds are therefore checkpointed,
    and every use and every recomputation reads the same ones. A row finds its bucket in two short lists."""
    keys, n = list(keys), side * side
    sketch = F.percentile_approx(order, [i / n for i in range(1, n)], 40 * n)
    bounds = cut_lineage(df.groupBy(*keys).agg(sketch.alias("_bounds")).select(
        *keys, F.transform(F.sequence(F.lit(1), F.lit(side - 1)), lambda i: F.element_at("_bounds", i * side)).alias("_coarse"),
        F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.slice("_bounds", i * side + 1, F.lit(side - 1))).alias("_fine")))
    below = lambda bound: bound < F.col(order)
    placed = attach(df, bounds, keys, "inner").withColumn("_first", F.size(F.filter("_coarse", below)))
    fine = F.size(F.filter(F.element_at("_fine", F.col("_first") + 1), below))
    return placed.withColumn("_bucket", F.col("_first") * side + fine).drop("_coarse", "_fine", "_first")


def running_total(df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], side: int = 16) -> DataFrame:
    """Inclusive running totals ``cum_<c>`` and group totals ``tot_<c>`` along a numeric order.

    Expects one row per (keys, order). Each group is cut into buckets of about equal depth; totals per bucket are summed
    up first, so no task sorts a whole group.
    """
    keys = list(keys)
    parts = equal_depth(df, keys, order, side)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    # At most 256 rows per group.
    totals = parts.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    offsets = totals.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0.0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(whole).alias(f"tot_{c}") for c in sums],
    )
    inner = (
        Window.partitionBy(*keys, "_bucket").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = parts.withColumns({f"_in_{c}": F.sum(c).over(inner) for c in sums})
    joined = attach(local, offsets, [*keys, "_bucket"], "inner")
    out = joined.withColumns({f"cum_{c}": F.col(f"_off_{c}") + F.col(f"_in_{c}") for c in sums})
    return out.drop("_bucket", *[f"_off_{c}" for c in sums], *[f"_in_{c}" for c in sums])


def fold_of(*keys: Column | str, folds: int = 5, seed: int = 42) -> Column:
    """Fold number from the respondent's own keys: no shuffle, stratified in expectation."""
    return (hash62(*keys, stream=seed) % F.lit(folds)).cast("int")


def stratified_folds(df: DataFrame, outcome: str, ids: Sequence[str], *, folds: int = 5, seed: int = 42, buckets: int = 1024) -> DataFrame:
    """``df`` with ``fold``: rows of each outcome dealt out in a random order, so that fold sizes differ by one at most.

    The order is that of the ids' hashes. A row's number is its rank in its hash bucket plus the sizes of the buckets
    before it; no window spans an outcome."""
    hashed = df.withColumn("_hash", hash62(*ids, stream=seed)).withColumn("_bucket", (F.col("_hash") % buckets).cast("int"))
    sizes = hashed.groupBy(outcome, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # At most ``buckets`` rows per outcome.
    before = Window.partitionBy(outcome).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(outcome, "_bucket").orderBy("_hash", *ids)
    ranked = hashed.withColumn("_rank", F.row_number().over(inside) - 1)
    return attach(ranked, offsets, [outcome, "_bucket"], "inner").withColumn(
        "fold", ((F.col("_before") + F.col("_rank")) % folds).cast("int")).drop("_hash", "_bucket", "_rank", "_before")
