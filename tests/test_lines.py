"""Numbered lines and sheets of real files."""

import pytest
from pyspark.sql import functions as F

from popgauge.operators.filters import keep_until
from popgauge.sources import numbered_lines, read_sheet


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def landed(tmp_path, **files):
    for name, lines in files.items():
        (tmp_path / f"{name}.txt").write_bytes(b"".join(lines))
    return str(tmp_path)


def by_file(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.file.rsplit("/", 1)[1].split(".")[0], []).append((r.line, r.value))
    return {k: sorted(v) for k, v in out.items()}


def test_numbers_over_many_splits(spark, tmp_path, small_splits):
    files = {
        "long": [f"row {i} {'x' * (i % 37)}\n".encode() for i in range(5000)],
        "windows": [f"r{i}\r\n".encode() for i in range(3000)],
        "wide": [b"title\n", b"y" * 20_000 + b"\n", b"\n", b"last without end"],
        "empty": [],
    }
    path = landed(tmp_path, **files)
    splits = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
    assert splits > 10
    got = by_file(numbered_lines(spark, path))
    assert got == {k: [(i, line.decode().rstrip("\r\n")) for i, line in enumerate(v)] for k, v in files.items() if v}


def test_sheet_below_titles(spark, tmp_path, small_splits):
    rows = [f'"name, {i}",{i},{"x" if i % 10 == 3 else i * 2},surplus\n'.encode() for i in range(2000)]
    path = landed(tmp_path, a=[b"Table 1\n", b"\n", b"Name,No,Twice,Rest\n", *rows, b"  \n", b"short\n"], b=[b"only a title\n"])
    got = sorted(tuple(r)[1:] for r in read_sheet(spark, path, "name string, no int, twice int", 2).collect())
    want = [(i + 3, f"name, {i}", i, None if i % 10 == 3 else i * 2) for i in range(2000)] + [(2004, "short", None, None)]
    assert got == want


def test_files_are_cut_at_their_own_last_row(spark, tmp_path, small_splits):
    path = landed(tmp_path, a=[f"{i}\n".encode() for i in range(3000)], b=[f"{i % 7}\n".encode() for i in range(50)], c=[b"9\n", b"8\n"])
    kept = by_file(keep_until(numbered_lines(spark, path), "line", F.col("value") == "6", ["file"]))
    assert {k: len(v) for k, v in kept.items()} == {"a": 7, "b": 7, "c": 2}


def test_nothing_landed(spark, tmp_path):
    assert numbered_lines(spark, landed(tmp_path, empty=[])).count() == 0
