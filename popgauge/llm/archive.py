"""Content-addressed web archive: payloads once, record heads apart, records by a join.

``write_archive`` turns a table of pages into WARC records and stores them as two tables in a shared folder:

* ``payloads`` (``digest, payload``): the bytes of every distinct payload once, under their SHA-256. Rows are united by
  digest *and* bytes, inside each task before anything is shuffled, so a payload that a third of all pages share moves
  once a task; two payloads under one digest would both be kept, are looked for after writing, and are an error.
* ``heads`` (``digest, head``): for each record the exact bytes before its payload, the WARC fields and the HTTP head. Of
  the records with equal payloads of at least ``least`` bytes one is a ``response``; the others are ``revisit`` records
  that refer to it and have no payload of their own. Shorter payloads are all ``response``.

``records`` joins the two tables by digest, checks that the stored bytes still have the digest they are filed under, and
gives each record's fields, its payload and its exact bytes. What a query does not ask for (the payload bytes, say) is
not read by the join. ``export_warc`` writes records to ordinary ``.warc.gz`` files, a gzip member a record, and
``import_warc`` takes such files into an archive; a round trip gives the same bytes.

Defined results: a NULL payload is an empty one; the response among equal payloads is the row with the smallest id (then
URL; NULL ids last); rows repeated in full are records of their own, of which one can be the response; a NULL id leaves
its field out and comes back as NULL; line ends in a URL are percent-encoded; an empty table gives an empty archive;
other columns are ignored.
"""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads of fewer bytes are never revisited.
LEAST = 100
#: Pages carry no date of their capture.
DATE = "1970-01-01T00:00:00Z"
END = "\r\n"
BLANK = b"\r\n\r\n"


def _record_id(page_id: Column, url: Column, digest: Column, copy: Column) -> Column:
    name = F.md5(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit("")), digest, copy.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """One header field; none where the value is NULL."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit(""))


def _heads(rows: DataFrame, least: int, date: str) -> DataFrame:
    """``digest, head`` of each record from ``page_id, url, digest, size``."""
    alike = rows.groupBy("page_id", "url", "digest", "size").agg(F.count(F.lit(1)).alias("copies"))
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    first = alike.where(F.col("size") >= least).groupBy("digest").agg(F.min(place).alias("first"))
    told = alike.join(first, "digest", "left").select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"))
    own = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url")) & (F.col("copy") == 0)
    again = F.col("first").isNotNull() & ~own
    safe_url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"), _line("Content-Length", F.col("size")), F.lit(END))
    only = lambda c: F.when(again, c)  # noqa: E731  fields of revisits
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", safe_url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", only(F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("WARC-Refers-To", only(_record_id(F.col("first.page_id"), F.col("first.url"), F.col("digest"), F.lit(0)))),
        _line("X-Refers-To-Page", only(F.col("first.page_id"))),
        _line("X-Page", F.col("page_id")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("size"))),
        F.lit(END), http,
    )
    return told.select("digest", head.cast("binary").alias("head"))


def _store(heads: DataFrame, payloads: DataFrame, folder: str) -> None:
    """Write both tables; two payloads of one digest are an error."""
    heads.write.option("compression", "zstd").parquet(f"{folder}/heads")
    payloads.select("digest", "payload").distinct().write.option("compression", "zstd").parquet(f"{folder}/payloads")
    clash = heads.sparkSession.read.parquet(f"{folder}/payloads").groupBy("digest").count().where("count > 1")
    if found := clash.head(1):
        raise ValueError(f"two payloads have the digest {found[0]['digest']}")


def write_archive(
    pages: DataFrame, folder: str, *, least: int = LEAST, date: str = DATE, page_id: str = "page_id", url: str = "url", payload: str = "html",
) -> None:
    """Store a WARC record for each row of ``pages`` under ``folder``, which must not exist yet."""
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("bigint").alias("size"))
    _store(_heads(rows.drop("payload"), least, date), rows, folder)


def field(name: str) -> Column:
    """A field of a record's head; NULL where it is missing."""
    found = F.regexp_extract(F.col("head").cast("string"), rf"(?m)^{name}: (.*)$", 1)
    return F.when(found != "", found)


def records(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest, record_bytes, payload, record`` of each
    record. ``payload`` is the full one, also of a revisit, whose own bytes (``record``) do not have it."""
    filed = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads").select(
        "digest", "payload", F.sha2("payload", 256).alias("found"), F.octet_length("payload").cast("bigint").alias("payload_bytes"))
    heads = spark.read.schema("digest string, head binary").parquet(f"{folder}/heads")
    whole = heads.join(filed, "digest", "left")
    sound = F.when(F.col("found") == F.col("digest"), F.col("found")).otherwise(
        F.raise_error(F.concat(F.lit("no payload, or another one, is filed under "), F.col("digest"))).cast("string"))
    own = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return whole.select(
        field("X-Page").cast(id_type).alias("page_id"), field("WARC-Target-URI").alias("url"), field("WARC-Type").alias("record_type"),
        field("X-Refers-To-Page").cast(id_type).alias("refers_to"), "payload_bytes", sound.alias("payload_digest"),
        (F.octet_length("head") + F.when(field("WARC-Type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes")) + 4).cast("bigint").alias("record_bytes"),
        "payload", F.concat(F.col("head"), own, F.lit(BLANK)).alias("record"),
    )


def export_warc(whole: DataFrame, folder: str) -> list[str]:
    """Write the column ``record`` to ``.warc.gz`` files under ``folder`` (a URI that all executors reach), a file for
    each partition. A file is written under a temporary name and moved, so that a task that runs again replaces it."""
    from pyspark import TaskContext

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        part = f"{root}/{name}.{uuid.uuid4().hex}.tmp"
        with files.open_output_stream(part, compression=None) as sink:
            for batch in batches:
                for record in batch.column(0):
                    sink.write(gzip.compress(record.as_py(), 6, mtime=0))
        files.move(part, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})

    return [row["path"] for row in whole.select("record").mapInArrow(write, "path string").collect()]  # a row for each file


def _members(source, at_once: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other."""
    left, done = b"", False
    while not done or left:
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if not left:
                left = source.read(at_once)
                if not left:
                    done = True
                    break
            parts.append(member.decompress(left))
            left = member.unused_data if member.eof else b""
        if parts and member.eof:
            yield b"".join(parts)
        elif any(parts):
            raise ValueError("a record is cut off")


def split_record(record: bytes) -> tuple[bytes, bytes]:
    """Head (with the HTTP head, where there is one) and payload of a record."""
    at = record.index(BLANK) + len(BLANK)
    fields = record[:at]
    length = int(re.search(rb"(?im)^Content-Length:\s*(\d+)", fields)[1])
    block = record[at:at + length]
    if re.search(rb"(?im)^Content-Type:\s*application/http", fields) and BLANK in block:
        at += block.index(BLANK) + len(BLANK)
    return record[:at], record[at:len(fields) + length]


def read_warc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``head, payload`` of the records of ``.warc.gz`` files; a task reads a file front to back."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, place = pafs.FileSystem.from_uri(path)
                with files.open_input_stream(place, compression=None) as source:
                    for record in _members(source):
                        head, payload = split_record(record)
                        yield pa.RecordBatch.from_arrays([pa.array([head], pa.binary()), pa.array([payload], pa.binary())], ["head", "payload"])

    named = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return named.mapInArrow(read, "head binary, payload binary")


def import_warc(spark: SparkSession, paths: list[str], folder: str) -> None:
    """Take the records of ``.warc.gz`` files into a new archive. A revisit is filed under the digest it names; one whose
    response is in none of the files is reported when it is read."""
    rows = read_warc(spark, paths).select("*", (field("WARC-Type") == "revisit").alias("again"))
    named = F.regexp_extract(F.col("head").cast("string"), r"(?m)^WARC-Payload-Digest: sha256:([0-9a-f]{64})$", 1)
    rows = rows.withColumn("digest", F.when(F.col("again"), named).otherwise(F.sha2("payload", 256)))
    _store(rows.select("digest", "head"), rows.where(~F.col("again")), folder)
