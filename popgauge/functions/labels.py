"""Binning numbers into labelled intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = math.inf


def interval_scheme(
    breaks: Sequence[float],
    unit: str = "",
    *,
    exact: bool = False,
    last_plus: bool = False,
    integer_style: bool = True,
) -> tuple[list[float], list[str]]:
    """Edges and labels for a list of breaks.

    Open-ended by default: "< b0", "b0+1–b1", ..., "bn+1+" (``integer_style``; otherwise the lower
    ends are shown as they are). ``exact`` names each break itself and needs ``last_plus``, as
    without it there would be as many labels as edges.
    """
    shift = 1 if integer_style else 0
    if exact:
        if not last_plus:
            raise ValueError("exact labels need last_plus: one label per interval")
        marks = [f"{b}" for b in breaks[:-1]] + [f"{breaks[-1]}+"]
        return [*breaks, INF], [f"{m} {unit}" for m in marks]
    inner = [f"{lo + shift}–{hi}" for lo, hi in zip(breaks, breaks[1:])]
    marks = [f"< {breaks[0]}", *inner, f"{breaks[-1] + shift}+"]
    return [-INF, *breaks, INF], [f"{m} {unit}" for m in marks]


def cut(
    value: Column | str,
    edges: Sequence[float],
    labels: Sequence[str],
    *,
    right: bool = True,
    include_lowest: bool = True,
) -> Column:
    """Label of the interval that holds ``value``; NULL when missing or outside all intervals.

    ``right`` closes intervals on the right, and ``include_lowest`` then closes the first one on the
    left as well; otherwise they are closed on the left and the last edge is outside.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError(f"{len(edges)} edges need {len(edges) - 1} labels, got {len(labels)}")
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    lowest = F.lit(float(edges[0]))
    inside = x >= lowest if include_lowest or not right else x > lowest
    chain = F.when(x.isNull() | F.isnan(x) | ~inside, None)
    for hi, label in zip(edges[1:], labels):
        top = F.lit(float(hi))
        chain = chain.when(F.lit(True) if hi == INF else x <= top if right else x < top, label)
    return chain


def cut_breaks(value: Column | str, breaks: Sequence[float], unit: str = "", *,
               right: bool = True, **style: bool) -> Column:
    """``cut`` with the edges and labels generated from ``breaks``."""
    edges, labels = interval_scheme(breaks, unit, **style)
    return cut(value, edges, labels, right=right)
