"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popgauge.functions.text import file_to_dataset

RESULT_SCHEMA = T.StructType([
    T.StructField("condition", T.StringType()),
    T.StructField("true_vals", T.ArrayType(T.StringType())),
    T.StructField("true_weights", T.ArrayType(T.DoubleType())),
    T.StructField("n_data", T.LongType()),
    T.StructField("total_weight", T.DoubleType()),
    T.StructField("model_vals", T.ArrayType(T.StringType())),
    T.StructField("model_weights", T.ArrayType(T.DoubleType())),
    T.StructField("model_texts", T.StringType()),
])

PROB_PREFIX = "PROB_"


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A clean table; only the named columns are read when given."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_once(df: DataFrame, path: str) -> None:
    """Write a table unless it is already there."""
    df.write.mode("ignore").parquet(path)


def header_rows(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Table in a JSON array of arrays whose first array is the header.

    The columns ``names`` are looked up in the header, in whatever order it has them.
    """
    grid = df.select(F.from_json(column, "array<array<string>>").alias("_grid"))
    header = F.element_at("_grid", 1)
    rows = grid.select(header.alias("_head"), F.posexplode("_grid").alias("_pos", "_row")).where(F.col("_pos") > 0)
    return rows.select(*[
        F.try_element_at("_row", F.nullif(F.array_position("_head", F.lit(n)), F.lit(0)).cast("int")).alias(n)
        for n in names
    ])


def skip_rows(df: DataFrame, ordinal: str, skip: int, names: Sequence[str]) -> DataFrame:
    """A landed sheet without its ``skip`` title rows and the header, columns renamed by position.

    ``ordinal`` is the 0-based row number the file was landed with.
    """
    kept = df.where(F.col(ordinal) > skip)
    values = [c for c in df.columns if c != ordinal][: len(names)]
    return kept.select(ordinal, *[F.col(c).alias(n) for c, n in zip(values, names)])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=header)


def read_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Result records (JSON); the file name is kept in ``file``."""
    df = spark.read.schema(RESULT_SCHEMA).json(path, multiLine=multi_line)
    return df.withColumn("file", F.col("_metadata.file_name"))


def write_results(records: DataFrame, path: str) -> None:
    """Result records as JSON lines, one folder per run; a run written again replaces its folder."""
    _replacing(records, "model", "prompting", "task_id").json(path)


def read_high_dim(spark: SparkSession, path: str) -> DataFrame:
    """High-dimensional results; run and task come from the folder names."""
    return spark.read.parquet(path)


def write_high_dim(df: DataFrame, path: str) -> None:
    """High-dimensional results, one folder per run; a run written again replaces its folder."""
    _replacing(df, "model", "prompting", "task_id").parquet(path)


def _replacing(df: DataFrame, *identity: str) -> DataFrameWriter:
    """Writer that replaces the partitions it has rows for and leaves the others."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*identity)


def legacy_identity(file_name: Column, task: Column) -> dict[str, Column]:
    """Identity held in an old file name "[PROB_]model_<task>.<ext>", given the task part."""
    bare = F.regexp_replace(file_name, f"^{PROB_PREFIX}", "")
    return {
        "prob": file_name.startswith(PROB_PREFIX),
        "model": F.regexp_replace(F.regexp_replace(bare, r"\.(parquet|json)$", ""), F.concat(F.lit("_"), task, F.lit("$")), ""),
        "dataset": file_to_dataset(task),
    }


def result_file_name(model: Column, dataset: Column, variables: Column, prob: Column, extension: str) -> Column:
    """Old-style file name of a result, for exchange with earlier result folders."""
    stem = F.array_join(F.concat(F.array(model, dataset), variables), "_")
    return F.concat(F.when(prob, PROB_PREFIX).otherwise(""), stem, F.lit(f".{extension}"))


def prune_high_dim(df: DataFrame, outcome: str, conditions: Sequence[str],
                   info: Sequence[str] = ("weight", "lgbm_pred", "llm_pred")) -> DataFrame:
    return df.select(outcome, *conditions, *info)


def map_entries(df: DataFrame, keep: Sequence[str], column: str) -> DataFrame:
    """Rows (keep.., key, value) of a JSON object of numbers."""
    parsed = F.from_json(column, "map<string,double>")
    return df.select(*keep, F.explode(parsed).alias("key", "value"))


def write_records(df: DataFrame, path: str) -> None:
    """Record export as JSON lines."""
    df.write.mode("overwrite").json(path)


def json_records(df: DataFrame) -> DataFrame:
    """Each row as one JSON object in the column ``record``."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))


def write_split(df: DataFrame, path: str) -> None:
    """Texts in one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def store_floors(floors: DataFrame, path: str) -> None:
    """Put noise floors into the store; a task's new floor replaces its old one."""
    _replacing(floors, "task_id").parquet(path)
