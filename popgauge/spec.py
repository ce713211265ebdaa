"""Task specifications: "distribution of an outcome given a condition", or P(yes | cell)."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Datasets that hold cell counts rather than respondents; their noise floor is 0.
AGGREGATE_DATASETS = ("edu", "fbi_arrests", "labor")

# Answers that count as the positive outcome of a binary variable.
POSITIVE_ANSWERS = ("Yes", "yes")

# Condition value given to marginal tasks (no conditioning variable).
ALL = "All"


@dataclass(frozen=True)
class Subset:
    """Row restriction: ``column >= at_least`` or ``column IN levels``."""

    column: str
    at_least: float | None = None
    levels: tuple[Any, ...] | None = None

    def predicate(self) -> Column:
        if (self.at_least is None) == (self.levels is None):
            raise ValueError(f"subset on {self.column!r} needs exactly one of at_least, levels")
        column = F.col(self.column)
        return column >= self.at_least if self.levels is None else column.isin(*self.levels)

    def as_list(self) -> list[Any]:
        if self.levels is None:
            return [self.column, "lwr", self.at_least]
        return [self.column, "levels", list(self.levels)]


@dataclass(frozen=True)
class LowDimTask:
    """Weighted distribution of ``outcome`` within each value of ``condition``."""

    task_id: int
    name: str
    dataset: str
    outcome: str
    condition: str | None = None
    subset: Subset | None = None
    cond_range: tuple[float, float] | None = None
    prompt: str = ""
    prompt_prob: str = ""
    weight: str | None = "weight"

    @property
    def variables(self) -> list[str]:
        return [self.outcome] + ([self.condition] if self.condition else [])

    def in_scope(self) -> Column:
        """True for rows that this task looks at (subset and condition range, NULL-safe)."""
        keep = F.lit(True)
        if self.condition:
            keep = F.col(self.condition).isNotNull()
            if self.cond_range:
                keep = keep & F.col(self.condition).between(*self.cond_range)
        if self.subset:
            keep = keep & F.coalesce(self.subset.predicate(), F.lit(False))
        return keep

    def condition_value(self) -> Column:
        return F.col(self.condition).cast("string") if self.condition else F.lit(ALL)

    def weight_value(self) -> Column:
        return F.col(self.weight).cast("double") if self.weight else F.lit(1.0)


@dataclass(frozen=True)
class HighDimTask:
    """P(outcome is positive | conditions) for every combination of the conditions."""

    task_id: int
    dataset: str
    outcome: str
    conditions: tuple[str, ...]
    weight: str | None = "weight"

    @property
    def variables(self) -> list[str]:
        return [self.outcome, *self.conditions]

    @property
    def dim(self) -> int:
        return len(self.conditions)

    def cell(self) -> Column:
        return F.array(*[F.col(c).cast("string") for c in self.conditions])

    def weight_value(self) -> Column:
        return F.col(self.weight).cast("double") if self.weight else F.lit(1.0)


TASK_SCHEMA = T.StructType([
    T.StructField("task_id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("v_out", T.StringType()),
    T.StructField("v_cond", T.ArrayType(T.StringType())),
    T.StructField("dim", T.IntegerType()),
    T.StructField("subset", T.StringType()),
    T.StructField("cond_range", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("prompt_prob", T.StringType()),
    T.StructField("weight_col", T.StringType()),
])


def task_frame(spark: SparkSession, tasks: Sequence[LowDimTask | HighDimTask]) -> DataFrame:
    """Task specs as rows; nested settings become JSON text. Spec-sized, so built on the driver."""
    rows = []
    for task in tasks:
        if isinstance(task, LowDimTask):
            rows.append((
                task.task_id, task.name, task.dataset, task.outcome,
                [task.condition] if task.condition else [], 1,
                json.dumps(task.subset.as_list()) if task.subset else None,
                json.dumps(list(task.cond_range)) if task.cond_range else None,
                task.prompt, task.prompt_prob, task.weight,
            ))
        else:
            rows.append((
                task.task_id, None, task.dataset, task.outcome, list(task.conditions), task.dim,
                None, None, None, None, task.weight,
            ))
    return spark.createDataFrame(rows, TASK_SCHEMA)
