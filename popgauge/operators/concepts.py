"""Declarative concept lists: which table and column a concept comes from, and how it is recoded."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgauge.functions.recode import apply_recoder
from popgauge.operators.joins import merge_by_id


@dataclass(frozen=True)
class Concept:
    """``column`` of ``table``; ``recoder`` names a registered recode, ``total`` sums per id."""

    name: str
    table: str
    column: str
    recoder: str | None = None
    total: bool = False


def select_concepts(tables: Mapping[str, DataFrame], concepts: Sequence[Concept], key: str) -> DataFrame:
    """One row per id with the concepts as columns; each source table is read once, needed columns only."""
    parts = []
    for name in dict.fromkeys(c.table for c in concepts):
        wanted = [c for c in concepts if c.table == name]
        raw = tables[name]
        plain = [c for c in wanted if not c.total]
        sums = [c for c in wanted if c.total]
        if sums and plain:
            totals = raw.groupBy(key).agg(
                *[F.sum(c.column).alias(c.name) for c in sums], *[F.min(c.column).alias(c.name) for c in plain]
            )
            part = totals.select(key, *[_recoded(c, c.name) for c in wanted])
        elif sums:
            part = raw.groupBy(key).agg(*[F.sum(c.column).alias(c.name) for c in sums])
        else:
            part = raw.select(key, *[_recoded(c, c.column) for c in plain])
        parts.append(part)
    return merge_by_id(parts, key)


def _recoded(concept: Concept, column: str):
    value = F.col(column) if concept.recoder is None else apply_recoder(concept.recoder, column)
    return value.alias(concept.name)
