"""Compare a probe query with its SQL on the same parquet tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return "NULL"
    if isinstance(value, float):
        if math.isnan(value):
            return "NULL"
        return repr(value + 0.0)
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return str(value)


def canonical(df: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(df.columns)
    return sorted(tuple(_cell(v) for v in row) for row in df[columns].astype(object).itertuples(index=False, name=None))


KINDS = {"int32": "int", "int64": "int", "int16": "int", "int8": "int", "uint8": "int"}


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str, limit: int = 5) -> list[str]:
    got = spark_df.toPandas()
    for field in spark_df.schema.fields:
        if field.dataType.simpleString() in ("int", "bigint") and got[field.name].dtype.kind == "f":  # some are missing
            got[field.name] = got[field.name].astype("Int64")
    relation = con.sql(sql)
    want = relation.df()
    problems = []
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    kinds = dict(zip(relation.columns, [str(t) for t in relation.types]))
    for field in spark_df.schema.fields:
        ours, theirs = field.dataType.simpleString(), kinds[field.name].lower()
        same = {"string": "varchar", "int": "integer", "bigint": "bigint", "double": "double", "boolean": "boolean",
                "date": "date"}.get(ours, ours)
        if same != theirs:
            problems.append(f"type of {field.name}: {ours} != {theirs}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    a, b = canonical(got), canonical(want)
    if a != b:
        only_a = sorted(set(a) - set(b))[:limit]
        only_b = sorted(set(b) - set(a))[:limit]
        problems.append(f"values differ: ours {only_a} theirs {only_b}")
    return problems
