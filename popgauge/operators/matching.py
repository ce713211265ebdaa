"""Chained imputation by regression on all other columns, with predictive mean matching.

Every column with gaps is regressed on all others. What a regression needs are the sums of products of all encoded
columns. Rows without a gap never change, so their sums are made once, by partitions, for all targets and rounds; only
rows with gaps are kept, encoded and summed again as their fills change. The sums are as large as the columns' levels
squared and the only thing that comes to the driver.

A numeric gap takes the observed value of one of the ``donors`` rows whose predicted values are nearest its own, drawn by
the row's keys, out of all rows that have the column. Donors and gaps are laid out by predicted value: bounds of equal
depth cut it into buckets, a bucket knows its neighbours' edge donors, and a bucket that ties have made large is dealt
over groups of bounded size, donors and gaps alike. A categorical gap draws an observed level by its predicted shares.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popgauge.functions.hashing import key_sum, stream_uniform
from popgauge.session import shared_path

#: Levels a column is encoded with, its most frequent ones (the others share the reference); donors of a bucket; ridge.
LEVELS, BUCKET, RIDGE = 200, 8_192, 1e-6


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Encoding:
    """How a row becomes numbers: 1, standardised numeric columns, a 0/1 number for each level."""

    def __init__(self, df: DataFrame, columns: Sequence[str]):
        kinds = {f.name: f.dataType for f in df.schema.fields}
        self.columns, self.numeric = list(columns), [c for c in columns if isinstance(kinds[c], T.NumericType)]
        texts = [c for c in columns if c not in self.numeric]
        sums = df.agg(F.lit(1), *[f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(self.numeric) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.mean = {c: sums[f"m_{i}"] or 0.0 for i, c in enumerate(self.numeric)}
        self.scale = {c: sums[f"s_{i}"] or 1.0 for i, c in enumerate(self.numeric)}
        self.levels: dict[str, list[str]] = {c: [] for c in texts}
        if texts:
            seen = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in texts]))).where("v IS NOT NULL")
            top = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "v"))
            for r in seen.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("p", top).where(F.col("p") <= LEVELS).orderBy("c", "p").collect():
                self.levels[r["c"]].append(r["v"])
        self.place, at = {}, 1
        for c in self.columns:
            width = 1 if c in self.numeric else len(self.levels[c])
            self.place[c], at = range(at, at + width), at + width
        self.size = at

    def value(self, c: str) -> Column:
        """The column as it is kept between rounds: a standardised number or a text."""
        return (F.col(c).cast("double") - F.lit(self.mean[c])) / F.lit(self.scale[c]) if c in self.numeric else F.col(c).cast("string")

    def start(self, c: str) -> Column:
        """What a gap holds before its first draw: the mean, or the most frequent level."""
        return F.lit(0.0) if c in self.numeric else F.lit(self.levels[c][0] if self.levels[c] else None).cast("string")

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, self.size))
        out[:, 0] = 1
        for c in self.columns:
            column, place = batch.column(batch.schema.get_field_index(c)), self.place[c]
            if c in self.numeric:
                out[:, place.start] = np.nan_to_num(column.to_numpy(zero_copy_only=False))
            else:
                code = {v: k for k, v in enumerate(self.levels[c])}
                found = np.array([code.get(v, -1) for v in column.to_pylist()], int)
                rows = np.flatnonzero(found >= 0)
                out[rows, place.start + found[rows]] = 1
        return out


def _products(rows: DataFrame, encoding: Encoding, observed: str | None = None) -> np.ndarray:
    """Sums of products of all encoded columns over the rows, or over those that have ``observed``."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((encoding.size, encoding.size))
        for batch in batches:
            x = encoding.matrix(batch)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": np.arange(encoding.size, dtype=np.int32), "v": list(total)})

    used = rows.where(~F.col(f"_gap_{observed}")) if observed else rows
    parts = used.select(*encoding.columns).mapInArrow(add, "i int, v array<double>")
    summed = parts.groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(encoding.size)]).alias("v"))
    out = np.zeros((encoding.size, encoding.size))
    for r in summed.collect():  # one row for each encoded column
        out[r["i"]] = r["v"]
    return out


def coefficients(products: np.ndarray, target: range) -> np.ndarray:
    """Least squares of the target's columns on all others (rows of the result; the target's own are 0)."""
    others = np.array([i for i in range(len(products)) if i not in target])
    left = products[np.ix_(others, others)]
    out = np.zeros((len(products), len(target)))
    out[others] = np.linalg.lstsq(left + RIDGE * max(products[0, 0], 1) * np.eye(len(others)), products[np.ix_(others, list(target))], rcond=None)[0]
    return out


def _predicted(rows: DataFrame, encoding: Encoding, beta: np.ndarray, *keep: str) -> DataFrame:
    """``keep`` columns and ``pred``: the predicted value, or the predicted share of each level."""
    frame = rows.select(*dict.fromkeys([*keep, *encoding.columns]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred = encoding.matrix(batch) @ beta
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(pred), pa.list_(pa.float64()))], [*keep, "pred"])

    schema = ", ".join(f"`{k}` {dict(frame.dtypes)[k]}" for k in keep)
    return frame.mapInArrow(predict, f"{schema}, pred array<double>")


def nearest_donors(donors: DataFrame, gaps: DataFrame, k: int, bucket: int = BUCKET) -> DataFrame:
    """(row, value): for each gap (``row, pred, u``) the value of one of the ``k`` donors (``pred, value``) nearest it.

    ``u`` in (0, 1) picks among them; equally near donors are taken by value, so any order of rows gives the same."""
    # No more than k rows alike can be among the k nearest.
    alike = donors.groupBy("pred", "value").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n"))
    donors = alike.select("pred", "value", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy"))
    count = donors.count()
    if not count:
        return gaps.select("row", F.lit(None).cast("double").alias("value"))
    pieces = -(-count // bucket)
    shares = [(i + 1) / pieces for i in range(pieces - 1)]
    bounds = sorted(set(donors.agg(F.percentile_approx("pred", shares, 10 * pieces).alias("b")).first()["b"])) if shares else []
    edges = F.array(*[F.lit(b) for b in bounds]).cast("array<double>")
    number = F.size(F.filter(edges, lambda b: b < F.col("pred")))
    placed = donors.withColumn("bucket", number)
    low, high = (Window.partitionBy("bucket").orderBy(F.col("pred").asc() if up else F.col("pred").desc(), "value") for up in (True, False))
    lent = placed.withColumn("l", F.row_number().over(low)).where(F.col("l") <= k).withColumn("bucket", F.col("bucket") - 1).drop("l").unionByName(
        placed.withColumn("l", F.row_number().over(high)).where(F.col("l") <= k).withColumn("bucket", F.col("bucket") + 1).drop("l"))
    salts = {r["bucket"]: -(-r["n"] // (2 * bucket)) for r in placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each bucket
    dealt = F.create_map(*[F.lit(x) for pair in salts.items() for x in pair])
    of = F.coalesce(F.try_element_at(dealt, F.col("bucket")), F.lit(1))
    own = placed.withColumn("salt", F.pmod(F.xxhash64("pred", "value", "copy"), of))
    edge = lent.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), (of - 1).cast("bigint"))))
    asked = gaps.withColumn("bucket", number).withColumn("salt", F.pmod(F.xxhash64("row"), of))

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})
        order = np.lexsort((left["value"].to_numpy(), left["pred"].to_numpy()))
        pred, value = left["pred"].to_numpy()[order], left["value"].to_numpy()[order]
        at, u = right["pred"].to_numpy(), right["u"].to_numpy()
        n, half = min(k, len(pred)), np.searchsorted(pred, at)
        first = np.clip(half - n, 0, len(pred) - n)
        offers = np.minimum(first[:, None] + np.arange(2 * n), len(pred) - 1)
        far = np.abs(pred[offers] - at[:, None])
        far[:, 1:][offers[:, 1:] == offers[:, :-1]] = np.inf
        ranked = np.take_along_axis(offers, np.argsort(far, axis=1, kind="stable"), 1)
        return pa.table({"row": right["row"].combine_chunks(), "value": value[ranked[np.arange(len(at)), np.minimum((u * n).astype(int), n - 1)]]})

    both = own.unionByName(edge).groupBy("bucket", "salt").cogroup(asked.groupBy("bucket", "salt"))
    return both.applyInArrow(choose, "row bigint, value double")


def impute_matched(df: DataFrame, columns: Sequence[str], ids: Sequence[str], *, rounds: int = 5, donors: int = 5, seed: int = 0) -> DataFrame:
    """``df`` with the gaps of ``columns`` filled, each from a regression on all the other ``columns``.

    Observed values never change, and a fill is always a value that some row has in that column. A column without any
    observed value stays empty. Draws are keyed by ``ids``, so the same table gives the same fills."""
    encoding = Encoding(df, columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    gap = {c: F.col(c).isNull() | (F.isnan(F.col(c)) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else F.lit(False)) for c in columns}
    flagged = df.select(F.struct(*df.columns).alias("_old"), *[encoding.value(c).alias(c) for c in columns], *[g.alias(f"_gap_{c}") for c, g in gap.items()], key_sum(*ids).alias("_keys"))
    some = F.greatest(*[F.col(f"_gap_{c}") for c in columns]) if len(columns) > 1 else F.col(f"_gap_{columns[0]}")
    whole = _stored(flagged.where(~some).select("_old", *columns), "matching-whole")
    work = _stored(flagged.where(some).withColumn("row", F.monotonically_increasing_id()).withColumns(
        {c: F.when(F.col(f"_gap_{c}"), encoding.start(c)).otherwise(F.col(c)) for c in columns}), "matching-gaps")
    flags = work.agg(F.lit(1), *[F.bool_or(f"_gap_{c}").alias(c) for c in columns]).first()
    targets = [c for c in columns if flags[c] and len(encoding.place[c]) > 0]
    fixed = _products(whole, encoding) if targets else None
    for r in range(rounds):
        for number, c in enumerate(targets):
            beta = coefficients(fixed + _products(work, encoding, c), encoding.place[c])
            u = stream_uniform(F.col("_keys"), seed + r * len(targets) + number)
            missing = work.where(F.col(f"_gap_{c}"))
            if c in encoding.numeric:
                one = F.col("pred")[0].alias("pred")
                offered = _predicted(whole, encoding, beta, c).unionByName(_predicted(work.where(~F.col(f"_gap_{c}")), encoding, beta, c)).select(one, F.col(c).alias("value"))
                asked = _predicted(missing.withColumn("u", u), encoding, beta, "row", "u").select("row", one, "u")
                drawn = nearest_donors(_stored(offered, "matching-donors"), asked, donors)
            else:
                shares = _predicted(missing.withColumn("u", u), encoding, beta, "row", "u").withColumn("w", F.transform("pred", lambda p: F.greatest(p, F.lit(1e-9))))
                summed = shares.withColumn("upto", F.transform(F.sequence(F.lit(1), F.size("w")), lambda n: F.aggregate(F.slice("w", F.lit(1), n), F.lit(0.0), lambda a, x: a + x)))
                at = F.least(F.size(F.filter("upto", lambda x: x <= F.col("u") * F.element_at("upto", -1))) + 1, F.size("w"))
                drawn = summed.select("row", F.element_at(F.array(*[F.lit(v) for v in encoding.levels[c]]), at).alias("value"))
            work = _stored(work.join(drawn, "row", "left").withColumn(c, F.coalesce("value", c)).drop("value"), "matching-gaps")

    def back(c: str) -> Column:
        if c not in targets:
            return F.col(f"_old.{c}")
        value = F.col(c) * F.lit(encoding.scale[c]) + F.lit(encoding.mean[c]) if c in encoding.numeric else F.col(c)
        exact = F.round(value).cast(kinds[c]) if isinstance(kinds[c], T.IntegralType) else value.cast(kinds[c])
        return F.when(F.col(f"_gap_{c}"), exact).otherwise(F.col(f"_old.{c}"))

    filled = work.select(*[(back(c) if c in columns else F.col(f"_old.{c}")).alias(c) for c in df.columns])
    return whole.select("_old.*").unionByName(filled)
