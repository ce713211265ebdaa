"""The web archive against brute force, and byte-exact round trips."""

import hashlib
import random

import pytest

from popgauge.llm import archive
from popgauge.session import shared_path

SCHEMA = "page_id bigint, url string, html string, digest string, head string, payload int, copy int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", "h", 1, 2) for i, u, h in rows], SCHEMA)


def awkward():
    r = random.Random(4)
    big, hot = "<p>" + "x" * 300_000 + "</p>", "<html>" + "copy " * 40 + "</html>"
    rows = [(None, "u0", hot), (1, None, None), (2, "u", ""), (3, "http://a/\r\nWARC-Type: forged", "short"), (4, "u", "short"),
            (5, "u", "é" * 50), (6, "u", "é" * 49), (7, "u", "é" * 50), (8, "u", big), (9, "u", big), (9, "u", big), (9, "v", big),
            (11, "u", "a\r\n\r\nb" * 30), (10, "u", "a\r\n\r\nb" * 30), (12, "u", "\x00" * 120)]
    return rows + [(100 + i, f"http://h/{i}", hot if i % 3 == 0 else f"page {r.random()} " * r.randrange(1, 20)) for i in range(60)]


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            first[b] = min(first.get(b, (True, 0)), (i is None, i or 0))
    out, owned = [], set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        b = (h or "").encode()
        again = b in first and (b in owned or first[b] != (i is None, i or 0))
        owned |= {b}
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b][1] if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def filed(spark):
    folder = shared_path(spark, "archive")
    archive.write_archive(pages(spark, awkward()), folder)
    return folder


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_matches_brute_force(spark, filed):
    assert sorted(map(tuple, archive.records(spark, filed).select(*COLUMNS).collect()), key=repr) == expected(awkward())


def test_payloads_are_stored_once(spark, filed):
    stored = [bytes(r["payload"]) for r in spark.read.parquet(f"{filed}/payloads").collect()]
    assert sorted(stored) == sorted({(h or "").encode() for _, _, h in awkward()})


def test_records_are_whole(spark, filed):
    for row in archive.records(spark, filed).collect():
        record, payload = bytes(row["record"]), bytes(row["payload"])
        head, own = archive.split_record(record)
        assert own == (b"" if row["record_type"] == "revisit" else payload)
        assert record == head + own + b"\r\n\r\n" and len(record) == row["record_bytes"]
        assert head.count(b"\nWARC-Type:") == 1


def test_files_round_trip(spark, filed):
    whole = archive.records(spark, filed)
    paths = archive.export_warc(whole.repartition(3), "file://" + shared_path(spark, "warc").removeprefix("file:"))
    again = shared_path(spark, "archive-again")
    archive.import_warc(spark, paths, again)
    columns = [*COLUMNS, "record"]
    assert sorted(map(repr, archive.records(spark, again).select(*columns).collect())) == sorted(map(repr, whole.select(*columns).collect()))


def test_wrong_bytes_are_found(spark, filed):
    bad = shared_path(spark, "archive-bad")
    spark.read.parquet(f"{filed}/heads").write.parquet(f"{bad}/heads")
    spark.read.parquet(f"{filed}/payloads").selectExpr("digest", "concat(payload, X'20') AS payload").write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="is filed under"):
        archive.records(spark, bad).select("payload_digest").collect()


def test_empty_table(spark):
    folder = shared_path(spark, "archive-empty")
    archive.write_archive(pages(spark, []), folder)
    assert archive.records(spark, folder).count() == 0
