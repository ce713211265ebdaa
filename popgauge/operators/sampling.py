"""Weighted samples, splits and draws, all seeded by the rows' own keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popgauge.functions.hashing import key_sum, once, stream_uniform, uniform, uniform_for_filter
from popgauge.session import cut_lineage


#: Rows that one task may put in order; bins of a histogram; expected draws of a row that are taken at once.
AT_ONCE, BINS, MOST = 1 << 16, 1024, 64


def smallest(df: DataFrame, key: str, n: int, ties: Sequence[str], at_once: int = AT_ONCE) -> DataFrame:
    """The ``n`` rows with the smallest ``key`` (in (0, 1)), equal ones by ``ties``.

    Beyond ``at_once`` rows the n-th key is found by histograms: each pass counts the bins of the one bin that holds it,
    until few enough rows are left to be put in order; all others are taken or left by a filter."""
    if n <= at_once:
        return df.orderBy(key, *ties).limit(n)
    sure, open_, low, width, rest = F.lit(False), F.lit(True), 0.0, 1.0 / BINS, n
    for _ in range(6):  # 1024 ** 6 bins are as fine as a double
        place = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        counts = {r["bin"]: r["n"] for r in df.where(open_).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()}  # BINS rows
        if sum(counts.values()) <= rest:
            return df.where(sure | open_)
        chosen, passed = 0, 0
        for chosen in sorted(counts):
            if passed + counts[chosen] >= rest:
                break
            passed += counts[chosen]
        sure, open_, rest = sure | (open_ & (place < chosen)), open_ & (place == chosen), rest - passed
        low, width = low + chosen * width, width / BINS
        if counts[chosen] <= at_once:
            break
    return df.where(sure).unionByName(df.where(open_).orderBy(key, *ties).limit(rest))


def weighted_sample(df: DataFrame, n: int, weight: str, ids: Sequence[str], *, seed: int = 0, at_once: int = AT_ONCE) -> DataFrame:
    """``n`` rows without replacement, chances proportional to weight: the n smallest -ln(u) / w."""
    key = -F.ln(uniform(*ids, stream=seed)) / F.col(weight)
    keyed = df.where(F.col(weight) > 0).withColumn("_key", key).withColumn("_place", F.col("_key") / (1 + F.col("_key")))
    return smallest(keyed, "_place", n, ["_key", *ids], at_once).drop("_key", "_place")


def _poisson(mean: Column, u: Column) -> Column:
    """Poisson count of any moderate mean, by inverting its distribution function at ``u``."""
    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), (state["f"] + p).alias("f"), (state["n"] + (u > state["f"] + p).cast("int")).alias("n"))

    none = F.exp(-mean)
    start = F.struct(none.alias("p"), none.alias("f"), F.lit(1).alias("n"))
    most = F.ceil(mean + 9 * F.sqrt(mean) + 30).cast("int")
    return F.when(u <= none, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["n"]))


def weighted_sample_replace(df: DataFrame, n: int, weight: str, ids: Sequence[str], *, seed: int = 0) -> DataFrame:
    """``n`` draws with replacement, chances proportional to weight; adds the draw number ``draw``.

    Counts of independent Poisson draws, given their sum, are multinomial, and so is what is left of them when draws are
    struck out at random. So one pass sums the weights, and one lets each row draw its own Poisson count, from its own
    keys, at a rate that gives a few more than ``n`` draws in all; rows without a draw go no further. Each draw gets a
    random number; the ``n`` smallest count, and their order numbers the draws. Rows are never sorted or shuffled."""
    weighted = df.where(F.col(weight) > 0)
    total = weighted.agg(F.sum(F.col(weight).cast("double"))).first()[0]
    if not total or n <= 0:
        return weighted.limit(0).select(F.lit(0).cast("bigint").alias("draw"), *df.columns)
    for attempt in range(100):  # the first one fails about once in 10 ** 15 times
        stream = seed + 1 + 1000 * attempt
        mean = F.col(weight).cast("double") * F.lit((n + 8 * n ** 0.5 + 20) / total)
        pieces = F.ceil(mean / MOST)
        laid = weighted.select(F.struct(*df.columns).alias("_row"), *[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)], (mean / pieces).alias("_mean"),
                               F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)).alias("_piece"))
        names = [f"_id{i}" for i in range(len(ids))]
        drawn = laid.withColumn("_keys", key_sum(*names, "_piece")).withColumn("_u", uniform_for_filter(F.col("_keys"), stream))
        counted = drawn.where(F.col("_u") > F.exp(-F.col("_mean"))).withColumn("_count", _poisson(F.col("_mean"), F.col("_u")))
        each = counted.select("_row", *names, "_piece", F.explode(F.sequence(F.lit(1), F.col("_count"))).alias("_copy"))
        hits = cut_lineage(each.withColumn("_at", uniform(*names, "_piece", "_copy", stream=stream + 1)))
        if hits.count() >= n:
            break
    ties = [*names, "_piece", "_copy"]
    kept = smallest(hits, "_at", n, ties).withColumn("_bin", F.floor(F.col("_at") * BINS).cast("int"))
    sizes = kept.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    # At most ``BINS`` rows.
    offsets = sizes.select("_bin", F.coalesce(F.sum("_n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = kept.withColumn("_rank", F.row_number().over(Window.partitionBy("_bin").orderBy("_at", *ties)) - 1)
    return ranked.join(F.broadcast(offsets), "_bin").select((F.col("_before") + F.col("_rank")).cast("bigint").alias("draw"), "_row.*")


def train_val_split(df: DataFrame, *ids: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds ``split``: "train" for about ``share`` of the rows, else "validation"."""
    train = uniform(*ids, stream=seed) < F.lit(share)
    return df.withColumn("split", F.when(train, "train").otherwise("validation"))


def level_lines(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: ordered levels with their upper cumulative weight, and the total. One question's
    levels per group, so the arrays are short."""
    ordered = F.array_sort(F.collect_list(F.struct("level", "w")))
    grouped = cells.where(F.col("w") > 0).groupBy(*keys).agg(ordered.alias("_e"), F.sum("w").alias("_total"))
    steps = F.transform(
        F.sequence(F.lit(1), F.size("_e")),
        lambda i: F.aggregate(F.slice(F.col("_e"), F.lit(1), i), F.lit(0.0), lambda acc, e: acc + e["w"]),
    )
    return grouped.select(*keys, F.col("_e.level").alias("_levels"), steps.alias("_upto"), "_total")


def pick_level(u: Column) -> Column:
    """Level whose cumulative share interval [lo, hi) holds ``u``; needs the ``level_lines`` columns."""
    return once(u * F.col("_total"), lambda at: F.try_element_at(
        F.col("_levels"), F.least(F.size(F.filter("_upto", lambda c: c <= at)) + 1, F.size("_levels"))))


def inverse_cdf_draws(cells: DataFrame, keys: Sequence[str], draws: int, *key_hashes: Column | str,
                      seed: int = 0) -> DataFrame:
    """``draws`` weighted draws of a level in each group: (keys.., draw, level)."""
    lines = level_lines(cells, keys)
    numbered = lines.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    keyed = numbered.withColumn("_keys", key_sum(*key_hashes, "draw"))
    return keyed.select(*keys, "draw", pick_level(stream_uniform(F.col("_keys"), seed)).alias("level"))
