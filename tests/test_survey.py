"""The probe survey folded in parts: the same cells, and nothing shuffled left behind."""

import os

import pytest
from pyspark.sql import functions as F

from popgauge.operators.cells import bootstrap_cells
from popgauge.probes import survey as S
from popgauge.session import cut_lineage

TABLES = {
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                 "l_discount double, l_tax double, l_returnflag string, l_linestatus string",
                 [(None if i % 31 == 0 else i % 40, i % 9, None if i % 37 == 0 else i % 6, i % 4, None if i % 23 == 0 else 1.0 + i % 50,
                   700.0 * (i % 140), i % 11 / 100, 0.02, "ANR"[i % 3], "OF"[i % 2]) for i in range(400)]),
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string",
               [(None if i == 39 else i % 37, i % 8, "FOP"[i % 3], 5000.0 * i, ["1-URGENT", "2-HIGH", None][i % 3]) for i in range(40)]),
    "customer": ("c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string", [(i % 7, i % 3, 1.0, f"S{i % 2}") for i in range(8)]),
    "part": ("p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double",
             [(i % 8, f"B{i % 2}", f"T{i % 3}", 5 + 9 * i, 1.0) for i in range(9)]),
    "supplier": ("s_suppkey long, s_nationkey int", [(i % 5, i % 3) for i in range(6)]),
    "nation": ("n_nationkey int, n_regionkey int", [(i, i) for i in range(3)]),
    "region": ("r_regionkey int, r_name string", list(enumerate(["AFRICA", "AMERICA", "ASIA"]))),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with repeated and missing keys."""
    path = str(tmp_path_factory.mktemp("survey"))
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def shuffled(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for top in dirs for _, _, files in os.walk(top.getPath()) for f in files if f.startswith("shuffle_")}


def rows(df):
    return sorted(str([round(x, 6) if isinstance(x, float) else x for x in row]) for row in df.collect())


def test_cells_leave_no_shuffled_files(spark, folder):
    before = shuffled(spark)
    cells, sums = S.low_cells(spark, folder), S.high_cells(spark, folder)
    assert not shuffled(spark) - before
    assert cells.count() and sums.count()


def test_a_released_frame_can_run_again(spark):
    df = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    kept = cut_lineage(df, release=True)
    assert rows(kept) == rows(df)


def test_parts_hold_each_row_once(spark, folder, monkeypatch):
    columns = [*S.TASK_COLUMNS, *S.RUN_COLUMNS]
    whole = S.survey(spark, folder, *columns)
    monkeypatch.setattr(S, "PART_BYTES", 1)
    parts = S.survey_parts(spark, folder, *columns)
    assert len(parts) == S.MOST_PARTS and all(part.count() for part in parts)
    assert sorted(r for part in parts for r in rows(part)) == rows(whole)


def test_cells_are_the_same_in_parts(spark, folder, monkeypatch):
    made = lambda: [
        S.low_cells(spark, folder), S.high_cells(spark, folder),
        bootstrap_cells(S.survey_parts(spark, folder, *S.CELL_COLUMNS), S.HIGH, S.IDS),
    ]
    whole = made()
    monkeypatch.setattr(S, "PART_BYTES", 1)
    monkeypatch.setattr(S, "MOST_PARTS", 3)
    monkeypatch.setattr(S, "BROADCAST_BYTES", 1)
    for one, other in zip(whole, made(), strict=True):
        assert one.dtypes == other.dtypes
        assert rows(one) == rows(other)
