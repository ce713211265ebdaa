"""Lines of landed text files under their own numbers, and the sheets made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popgauge.operators.joins import attach
from popgauge.session import cut_lineage


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value``: every line of the text files at ``path`` with its 0-based number in its file.

    Files stay splittable. The lines of a split come in file order in one task, so a line's distance from the first row
    of its split is its rank there; how many lines come before a split is counted in a pass that reads no text out. What
    is joined is one row per split. Reading goes through Spark, so any store that it reaches will do; compressed files
    are one split each. A line whose split was not counted (the files changed in between) is an error.
    """
    scan = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"), "value")
    splits = scan.groupBy("file", "_split").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)  # splits of one file
    starts = cut_lineage(splits.select(
        "file", "_split", "_first", "_lines", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before")))
    rank = F.col("_at") - F.col("_first")
    sound = rank.between(0, F.col("_lines") - 1)
    changed = F.raise_error(F.concat(F.lit("changed while it was read: "), F.col("file"))).cast("bigint")
    placed = attach(scan, starts, ["file", "_split"])
    return placed.select("file", F.when(F.coalesce(sound, F.lit(False)), F.col("_before") + rank).otherwise(changed).alias("line"), "value")


def read_sheet(spark: SparkSession, path: str, columns: T.StructType | str, titles: int, separator: str = ",") -> DataFrame:
    """``file, line`` and ``columns`` of delimited sheets, below their ``titles`` title rows and the header.

    ``columns`` names the fields by position, whatever the header says. A field that is missing or cannot be read as its
    type is NULL; surplus fields and blank lines are left out; fields hold no line breaks.
    """
    schema = columns if isinstance(columns, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.fields)
    body = numbered_lines(spark, path).where((F.col("line") > titles) & (F.trim("value") != ""))
    fields = F.from_csv("value", schema, {"sep": separator})
    return body.select("file", "line", fields.alias("_fields")).select("file", "line", "_fields.*")
