"""Row filters of the table builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popgauge.operators.joins import attach


def drop_headings(df: DataFrame, column: str, headings: Sequence[str], pattern: str | None = None) -> DataFrame:
    """Rows whose name is neither a listed heading nor matches the pattern (in any case)."""
    keep = ~F.coalesce(F.col(column).isin(*headings), F.lit(False))
    if pattern:
        keep = keep & ~F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False))
    return df.where(keep)


def keep_until(df: DataFrame, ordinal: str, marker: Column, within: Sequence[str] = ()) -> DataFrame:
    """Rows up to and including the first one that the marker holds for; all rows if there is none.

    With ``within`` each of its values (the files of a folder, say) is cut at its own first marker; NULL is a value."""
    if within:
        until = df.where(marker).groupBy(*within).agg(F.min(ordinal).alias("_until"))
        marked = attach(df, until, list(within))
        return marked.where(F.col("_until").isNull() | (F.col(ordinal) <= F.col("_until"))).drop("_until")
    first = df.where(marker).agg(F.min(ordinal).alias("_until")).withColumn("_one", F.lit(1))
    # One row, whatever the size of the table.
    marked = df.withColumn("_one", F.lit(1)).join(F.broadcast(first), "_one")
    return marked.where(F.col("_until").isNull() | (F.col(ordinal) <= F.col("_until"))).drop("_one", "_until")
