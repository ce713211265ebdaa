"""Gradient-boosted P(yes | conditions), with all sums made by Spark.

Histogram boosting as on a cluster: what a split choice needs are the sums of gradients and Hessians for every
(fit, leaf, condition, value). Each level of a round is one Spark job over the cells: every task scores its cells under
the trees so far, and adds up what its cells give to those sums; Spark adds the tasks' sums; the choice is made from
them. The job serves all fits at once - every task, replicate and held-out fold - so the number of jobs is rounds times
depth, whatever they are. No task holds a fit's cells together, and what comes to the driver is as long as fits x leaves
x conditions x values, which the specs bound: a condition counts at most ``BINS`` values of its own, its most frequent
ones, and the others together; numeric conditions are cut at ``CUTS`` quantiles instead.

Respondents who share fold, outcome and (binned) conditions are interchangeable and are folded into one weighted cell
first, in one scan for all tasks. Trees are symmetric in shape, not in splits: ``DEPTH`` levels, each leaf with its own
split. A fit ends when the loss on its held-out fold has not fallen by ``LEAST_FALL`` of itself for ``patience`` rounds;
its best round counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popgauge.functions.hashing import key_sum, poisson_counts
from popgauge.operators.joins import fold_of
from popgauge.operators.tabulate import positive
from popgauge.session import shared_path
from popgauge.spec import HighDimTask

UNKNOWN = "(missing)"
#: Levels of a tree, step of a round, penalty on a leaf (in respondents of average weight), values of a condition, quantile cuts.
DEPTH, RATE, PENALTY, BINS, CUTS = 3, 0.3, 1.0, 254, 31
#: A round that lowers the held-out loss by less than this share of it does not count as better.
LEAST_FALL = 1e-4


def _binned(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    """Text of each condition's value; of numeric ones the interval between quantiles it lies in, numbered by its place."""
    numeric = [f.name for f in df.schema.fields if f.name in names and isinstance(f.dataType, T.NumericType)]
    out = {c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in names}
    if numeric:
        shares = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
        cuts = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in numeric]).first()
        for c in numeric:
            edges = sorted(set(cuts[c] or []))
            value, chain = F.col(c).cast("double"), F
            for i, edge in enumerate(edges):
                low = f"over {edges[i - 1]:g} " if i else ""
                chain = chain.when(value <= edge, F.lit(f"{i:03d}: {low}up to {edge:g}"))
            last = F.lit(f"{len(edges):03d}: over {edges[-1]:g}") if edges else F.lit("000: any")
            whole = chain.otherwise(last) if edges else last
            out[c] = F.when(value.isNull() | F.isnan(value), F.lit(UNKNOWN)).otherwise(whole)
    return out


@dataclass
class Cells:
    """Stored cells of all tasks and what is known of them: (task, cell, codes, y, fold, w array, n)."""

    path: str
    spark: object
    tasks: Sequence[HighDimTask]
    weights: int
    folds: int
    #: For each task and condition: number of codes, and whether their order means something.
    sizes: list[list[int]] = field(default_factory=list)
    ordered: list[list[bool]] = field(default_factory=list)

    def read(self) -> DataFrame:
        return self.spark.read.schema(
            "task int, cell array<string>, codes array<int>, y double, fold int, w array<double>, n bigint").parquet(self.path)


def training_cells(df: DataFrame, tasks: Sequence[HighDimTask], ids: Sequence[str], *, folds: int, seed: int, replicates: int = 0) -> Cells:
    """Weighted cells by outcome and fold, from one scan; ``w`` has the weight and its Poisson replicates."""
    spark, names = df.sparkSession, list(dict.fromkeys(c for t in tasks for c in t.conditions))
    outcomes, weights = list(dict.fromkeys(t.outcome for t in tasks)), list(dict.fromkeys(t.weight for t in tasks))
    own = {t.weight: t.weight_value() for t in tasks}
    drawn = df
    if replicates:
        drawn = df.withColumn("_keys", key_sum(*ids)).withColumn("_counts", poisson_counts(F.col("_keys"), range(seed + 1000, seed + 1000 + replicates)))
    counts = {f"_c{b}": F.col("_counts")[b] for b in range(replicates)}
    rows = drawn.select(
        *[c.alias(f"_x{i}") for i, c in enumerate(_binned(df, names).values())], *[positive(F.col(o)).alias(f"_y{i}") for i, o in enumerate(outcomes)],
        fold_of(*ids, folds=folds, seed=seed).alias("fold"), *[own[w].alias(f"_w{i}") for i, w in enumerate(weights)], *[c.alias(name) for name, c in counts.items()])
    sums = [F.sum(F.col(f"_w{i}") * (F.col(c) if c else 1)).alias(f"_w{i}{c or ''}") for i in range(len(weights)) for c in (None, *counts)]
    finest = rows.groupBy(*[f"_x{i}" for i in range(len(names))], *[f"_y{i}" for i in range(len(outcomes))], "fold").agg(*sums, F.count(F.lit(1)).alias("n"))
    place = shared_path(spark, "boosting-finest")
    finest.write.parquet(place)
    finest = spark.read.schema(finest.schema).parquet(place)

    # Codes of the values: the most frequent ones in their order, 0 for all others.
    seen = finest.select("n", F.inline(F.array(*[F.struct(F.lit(i).alias("v"), F.col(f"_x{i}").alias("value")) for i in range(len(names))])))
    totals = seen.groupBy("v", "value").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("n"), "value"))
    top = totals.withColumn("place", place).where(F.col("place") <= BINS).collect()  # BINS rows for each condition
    codes = [{value: k + 1 for k, value in enumerate(sorted(r["value"] for r in top if r["v"] == i))} for i in range(len(names))]

    def code(i: int) -> Column:
        known = F.create_map(*[F.lit(x) for pair in codes[i].items() for x in pair]) if codes[i] else F.lit(None).cast("map<string,int>")
        return F.coalesce(F.try_element_at(known, F.col(f"_x{i}")), F.lit(0))

    entries = [
        F.struct(
            F.lit(k).alias("task"), F.array(*[F.col(f"_x{names.index(c)}") for c in t.conditions]).alias("cell"),
            F.array(*[code(names.index(c)) for c in t.conditions]).alias("codes"), F.col(f"_y{outcomes.index(t.outcome)}").alias("y"), "fold",
            F.array(*[F.col(f"_w{weights.index(t.weight)}{c or ''}") for c in (None, *counts)]).alias("w"), "n")
        for k, t in enumerate(tasks)
    ]
    laid = finest.select(F.inline(F.array(*entries))).where("y IS NOT NULL")
    whole = laid.groupBy("task", "cell", "codes", "y", "fold").agg(
        F.array(*[F.sum(F.col("w")[j]) for j in range(replicates + 1)]).alias("w"), F.sum("n").alias("n"))
    place = shared_path(spark, "boosting-cells")
    whole.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(place)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    return Cells(place, spark, tasks, replicates + 1, folds, [[len(codes[names.index(c)]) + 1 for c in t.conditions] for t in tasks],
                 [[c in numeric for c in t.conditions] for t in tasks])


@dataclass
class Trees:
    """The fits of one task: (replicate, held-out fold) pairs, their start scores and their trees, round after round."""

    fits: list[tuple[int, int]]
    start: np.ndarray
    scale: np.ndarray
    #: Per round: condition of each inner node (-1: none), values that go left, values of the leaves.
    rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def walk(self, codes: np.ndarray, of: np.ndarray, tree: tuple, depth: int) -> np.ndarray:
        """Node of every row (rows of ``codes``) under one tree of the fits ``of`` after ``depth`` levels."""
        condition, left, _ = tree
        fit, node = np.arange(len(of))[None, :], np.zeros((len(codes), len(of)), np.int64)
        row = np.arange(len(codes))[:, None]
        for level in range(depth):
            at = node + (1 << level) - 1
            split = condition[of[fit], at]
            value = codes[row, np.maximum(split, 0)]
            node = 2 * node + ((split >= 0) & ~left[of[fit], at, value])
        return node

    def scores(self, codes: np.ndarray, of: np.ndarray, upto: np.ndarray | None = None) -> np.ndarray:
        """Score of every row under the fits ``of``, with all rounds or ``upto`` rounds of each."""
        out = np.repeat(self.start[of][None, :], len(codes), 0)
        for number, tree in enumerate(self.rounds):
            some = of if upto is None else of[upto[of] > number]
            if len(some):
                value = tree[2][some[None, :], self.walk(codes, some, tree, DEPTH)]
                out[:, np.isin(of, some)] += value
        return out


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, ...]]:
    """(task, codes, y, fold, w) of the rows of each task in a batch."""
    task = batch.column("task").to_numpy()
    for t in np.unique(task):
        rows = batch.filter(pa.array(task == t))
        n = rows.num_rows
        codes, w = (rows.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("codes", "w"))
        yield int(t), codes, rows.column("y").to_numpy(), rows.column("fold").to_numpy(), w


def _sums(cells: Cells, models: list[Trees], active: list[np.ndarray], level: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """One job: per task the sums (fit, node, condition, value, [g, h]) of the active fits, and, on level 0, their held-out losses."""
    widths = [max(s) for s in cells.sizes]
    nodes = 1 << level

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for t, codes, y, fold, w in _arrays(batch):
                of, model = active[t], models[t]
                if not len(of):
                    continue
                use = w[:, [model.fits[f][0] for f in of]] * model.scale[of]
                done = model.rounds[:-1] if level else model.rounds
                score = Trees(model.fits, model.start, model.scale, done).scores(codes, of)
                node = model.walk(codes, of, model.rounds[-1], level) if level else np.zeros(score.shape, np.int64)
                p = 1 / (1 + np.exp(-score))
                out = fold[:, None] == np.array([model.fits[f][1] for f in of])[None, :]
                g, h = np.where(out, 0, (p - y[:, None]) * use), np.where(out, 0, p * (1 - p) * use)
                shape = (len(of), nodes, codes.shape[1], widths[t])
                if t not in held:
                    held[t] = (np.zeros(shape), np.zeros(shape), np.zeros(len(of)))
                fit = np.arange(len(of))[None, :]
                for c in range(codes.shape[1]):
                    slot = ((fit * nodes + node) * codes.shape[1] + c) * widths[t] + codes[:, c][:, None]
                    for total, value in zip(held[t], (g, h)):
                        total += np.bincount(slot.ravel(), value.ravel(), total.size).reshape(shape)
                if not level:
                    loss = -(y[:, None] * np.log(p + 1e-15) + (1 - y[:, None]) * np.log(1 - p + 1e-15))
                    held[t][2][:] += np.where(out, loss * use, 0).sum(0)
        for t, (g, h, loss) in held.items():
            slots = np.flatnonzero(h)
            losses = -1 - np.arange(len(loss))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(slots) + len(loss), t, np.int32)), pa.array(np.concatenate([slots, losses])),
                pa.array(np.concatenate([g.ravel()[slots], loss])), pa.array(np.concatenate([h.ravel()[slots], np.zeros(len(loss))]))],
                ["task", "slot", "g", "h"])

    total = cells.read().drop("cell", "n").mapInArrow(add, "task int, slot bigint, g double, h double").groupBy("task", "slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    frame = total.toPandas()  # fits x leaves x conditions x values
    sums, losses = [], []
    for t, of in enumerate(active):
        mine, shape = frame[frame["task"] == t], (len(of), nodes, len(cells.sizes[t]), widths[t])
        both = np.zeros((2, int(np.prod(shape))))
        real = mine[mine["slot"] >= 0]
        both[:, real["slot"].to_numpy()] = real[["g", "h"]].to_numpy().T
        loss = np.zeros(len(of))
        told = mine[mine["slot"] < 0]
        loss[-1 - told["slot"].to_numpy()] = told["g"].to_numpy()
        sums.append(both.reshape(2, *shape))
        losses.append(loss)
    return sums, losses


def _splits(sums: np.ndarray, ordered: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best split of each (fit, node): condition (-1: none gains), values that go left, (g, h) left and right of it."""
    g, h = sums
    fits, nodes, conditions, width = g.shape
    key = np.where(h > 0, g / (h + PENALTY), np.inf)
    key[:, :, ordered] = np.where(h[:, :, ordered] > 0, np.arange(width), np.inf)
    order = np.argsort(key, axis=-1, kind="stable")
    left_g, left_h = (np.cumsum(np.take_along_axis(x, order, -1), -1) for x in (g, h))
    all_g, all_h = left_g[..., -1:], left_h[..., -1:]
    gain = left_g ** 2 / (left_h + PENALTY) + (all_g - left_g) ** 2 / (all_h - left_h + PENALTY) - all_g ** 2 / (all_h + PENALTY)
    some = np.take_along_axis(h > 0, order, -1)
    real = some & np.concatenate([some[..., 1:], np.zeros_like(some[..., :1])], -1)  # a value on either side
    gain = np.where(real, gain, 0.0).reshape(fits, nodes, -1)
    at = gain.argmax(-1)
    best = np.take_along_axis(gain, at[..., None], -1)[..., 0]
    c, cut = np.divmod(at, width)
    rank = np.argsort(np.take_along_axis(order, c[..., None, None], 2)[:, :, 0], axis=-1)
    left = rank <= cut[..., None]
    pick = lambda x: np.take_along_axis(np.take_along_axis(x, c[..., None, None], 2)[:, :, 0], cut[..., None], -1)[..., 0]
    lg, lh = pick(left_g), pick(left_h)
    tg, th = all_g[:, :, 0, 0], all_h[:, :, 0, 0]
    split = np.where(best > 1e-9, c, -1)
    none = split < 0
    lg, lh = np.where(none, tg, lg), np.where(none, th, lh)
    return split, left, np.stack([np.stack([lg, tg - lg], -1), np.stack([lh, th - lh], -1)])


def _start(cells: Cells) -> list[Trees]:
    """The fits of every task at their training folds' log odds."""
    w = F.posexplode("w").alias("b", "w")
    rows = cells.read().select("task", "fold", "y", "n", w).groupBy("task", "fold", "b").agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum("n").alias("n")).toPandas()  # tasks x folds x replicates
    out = []
    fits = [(b, k) for b in (range(1, cells.weights) if cells.weights > 1 else [0]) for k in range(cells.folds)]
    for t in range(len(cells.tasks)):
        mine, start, scale = rows[rows["task"] == t], [], []
        for b, k in fits:
            train = mine[(mine["b"] == b) & (mine["fold"] != k)][["w", "wy", "n"]].sum()
            share = np.clip(train["wy"] / train["w"] if train["w"] > 0 else 0.5, 1e-6, 1 - 1e-6)
            start.append(np.log(share / (1 - share)))
            scale.append(train["n"] / train["w"] if train["w"] > 0 else 0.0)
        out.append(Trees(fits, np.array(start), np.array(scale)))
    return out


def fitted(cells: Cells, rounds: int, patience: int) -> tuple[list[Trees], list[np.ndarray], int]:
    """The trees of all fits, the number of rounds that counts for each, and the number of jobs it took."""
    models, jobs = _start(cells), 1
    n = [len(m.fits) for m in models]
    least, best = [np.full(k, np.inf) for k in n], [np.zeros(k, int) for k in n]
    active = [np.arange(k) for k in n]
    for number in range(rounds + 1):
        sums, losses = _sums(cells, models, active, 0)
        jobs += 1
        for t, of in enumerate(active):
            better = losses[t] < least[t][of] * (1 - LEAST_FALL)
            least[t][of[better]], best[t][of[better]] = losses[t][better], number
        keep = [number - best[t][of] < patience for t, of in enumerate(active)]
        sums = [s[:, k] for s, k in zip(sums, keep)]
        active = [of[k] for of, k in zip(active, keep)]
        if number == rounds or not any(len(of) for of in active):
            break
        for t, m in enumerate(models):
            inner = (1 << DEPTH) - 1
            m.rounds.append((np.full((n[t], inner), -1), np.zeros((n[t], inner, max(cells.sizes[t])), bool), np.zeros((n[t], 1 << DEPTH))))
        for level in range(DEPTH):
            if level:
                sums, _ = _sums(cells, models, active, level)
                jobs += 1
            for t, of in enumerate(active):
                if not len(of):
                    continue
                split, left, sides = _splits(sums[t], cells.ordered[t])
                condition, lefts, leaves = models[t].rounds[-1]
                at = slice((1 << level) - 1, (1 << (level + 1)) - 1)
                condition[of, at], lefts[of, at] = split, left
                if level == DEPTH - 1:
                    leaves[of] = (-RATE * sides[0] / (sides[1] + PENALTY)).reshape(len(of), -1)
    return models, best, jobs


def boosted(df: DataFrame, tasks: Sequence[HighDimTask], ids: Sequence[str], *, replicates: int = 0, folds: int = 5, rounds: int = 40,
            patience: int = 3, seed: int = 42) -> DataFrame:
    """(task_id, cell, fold, b, w, p): predictions of each cell by the fit that never saw its fold, for all tasks at once.

    With ``replicates``, ``b`` numbers fits under Poisson bootstrap weights; otherwise it is 0 and the fits use the weights.
    Folds go by respondent, so the copies of one respondent never sit on both sides of a split."""
    cells = training_cells(df, tasks, ids, folds=folds, seed=seed, replicates=replicates)
    models, best, _ = fitted(cells, rounds, patience)
    named = [t.task_id for t in tasks]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, codes, _, fold, w in _arrays(batch):
                score = models[t].scores(codes, np.arange(len(models[t].fits)), best[t]).reshape(len(codes), -1, folds)
                own = np.take_along_axis(score, fold.astype(int)[:, None, None], 2)[:, :, 0]
                many = own.shape[1]
                rows = batch.filter(pa.array(batch.column("task").to_numpy() == t)).column("cell").take(pa.array(np.repeat(np.arange(len(codes)), many)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), named[t], np.int32)), rows, pa.array(np.repeat(fold, many).astype(np.int32)),
                    pa.array(np.tile(np.arange(many, dtype=np.int32), len(codes))), pa.array(np.repeat(w[:, 0], many)), pa.array(1 / (1 + np.exp(-own.ravel())))],
                    ["task_id", "cell", "fold", "b", "w", "p"])

    told = cells.read().mapInArrow(predict, "task_id int, cell array<string>, fold int, b int, w double, p double")
    return told.groupBy("task_id", "cell", "fold", "b").agg(F.sum("w").alias("w"), F.first("p").alias("p"))


def _of_task(out: DataFrame, task: HighDimTask) -> DataFrame:
    return out.select(*[F.col("cell")[i].alias(c) for i, c in enumerate(task.conditions)], "fold", "b", "w", "p")


def oof_boosted(df: DataFrame, task: HighDimTask, ids: Sequence[str], *, folds: int = 5, rounds: int = 40,
                patience: int = 3, seed: int = 42) -> DataFrame:
    """(conditions.., fold, w, p) of one task; see ``boosted``."""
    return _of_task(boosted(df, [task], ids, folds=folds, rounds=rounds, patience=patience, seed=seed), task).drop("b")


def bootstrap_boosted(df: DataFrame, task: HighDimTask, ids: Sequence[str], *, replicates: int = 10,
                      folds: int = 5, rounds: int = 40, patience: int = 3, seed: int = 42) -> DataFrame:
    """(conditions.., fold, b, w, p_b) of one task under Poisson bootstrap weights; see ``boosted``."""
    out = boosted(df, [task], ids, replicates=replicates, folds=folds, rounds=rounds, patience=patience, seed=seed)
    return _of_task(out, task).withColumnRenamed("p", "p_b")
