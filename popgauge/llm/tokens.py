"""Token ids in Arrow files of fixed-size lists.

Documents are put in the order of their ids by one range shuffle; each ordered partition is encoded and written by
its own task as one Arrow file (the random-access IPC format). The file holds the partition's token stream, one end
id after each document, cut into sequences of equal length: a ``fixed_size_list`` column of ids and one of booleans
that mark the ids that are real (the last sequence is padded), in record batches of a fixed number of sequences. A
mapped file gives sequence ``i`` without a copy. A second small Arrow file lists the documents of the stream. Files
are written under a temporary name and moved, so that a task that runs again replaces its file.

Defined results: NULL and empty texts give the end id only; NULL document ids come first; rows with equal ids stand
next to each other in the order of their texts' hashes; an empty table gives no file; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from popgauge.llm.common import binary, lean, slices


#: Kinds of bytes that a chunk may begin with: a blank, the end of a line, punctuation.
_BLANK, _LINE, _POINT = 1, 2, 3
_SPACE, _LETTER, _SOLID = (np.isin(np.arange(256), [*map(ord, c)]) for c in (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f", string.ascii_letters, map(chr, range(33, 127))))
#: First bytes of characters of which some are blanks, and those blanks.
_MAYBE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")


def _cuts(data: bytes, kinds: np.ndarray) -> np.ndarray:
    """Places in UTF-8 text where a chunk may begin; ``kinds``: those of the 256 bytes."""
    line = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(kinds[line[:-1]])
    kind, after, before = kinds[line[at]], line[at + 1], line[at - 1]
    # Also the letters from U+00C0 to U+00FF, all but two of these characters.
    letter = _LETTER[before] | (line[at - 2] == 0xC3) & (before > 0x7F) & (before != 0x97) & (before != 0xB7)
    keep = np.choose(kind - 1, [~_SPACE[after], letter | _SOLID[before], letter])
    maybe = np.flatnonzero(_MAYBE[after] & (kind == _BLANK))
    keep[maybe] = [_WIDE_SPACE.match(data, i + 1) is None for i in at[maybe].tolist()]
    return at[keep]


class Encoder:
    """Whole-text encoding with the tokenizers library that encodes each distinct chunk once.

    A text is cut before every blank that is followed by a non-blank character, before the end of a line behind a
    non-blank one, and between a letter and a point, comma or the like. A byte-level pre-tokenizer never joins characters
    over such a cut (a blank opens the next piece, blanks before it form a piece of their own, letters end where others
    begin), so the ids of a text are those of its chunks in a row. Chunks are cut, told apart and put in a row again for
    many texts at once; only distinct chunks become Python objects."""

    #: Bytes of chunks and ids remembered (with ``ENTRY`` for each one's objects), chunks encoded at once, and bytes of
    #: texts taken together (one text may have more).
    MOST, ENTRY, AT_ONCE, GROUP = 96 << 20, 230, 256, 4 << 20

    def __init__(self, path: str):
        # A task owns one core; the library's threads would take others, and keep memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.width = self.kind.itemsize
        #: Bytes that each id stands for: a byte-level token has one character a byte.
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = list(map(len, vocabulary))
        self.kinds = np.zeros(256, np.uint8)
        for kind, characters in ((_BLANK, b" "), (_LINE, b"\n"), (_POINT, b".,;:!?")):
            self.kinds[list(characters)] = kind
        for token in self.tokenizer.get_added_tokens_decoder().values():  # found in whole texts, whatever is around them
            self.kinds[list(token.content.encode())] = 0
        #: Ids by chunk: those met since ``older`` was set aside, and those met before.
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        kind, out = "H" if self.width == 2 else "I", []
        for at in range(0, len(chunks), self.AT_ONCE):
            found = self.tokenizer.encode_batch_fast([c.decode() for c in chunks[at:at + self.AT_ONCE]], add_special_tokens=False)
            out += [array(kind, e.ids).tobytes() for e in found]
        return out

    def _ids_after_blank(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of chunks that begin with a blank or the end of a line. Many are encoded as one text, whose ids are dealt out by the
        bytes they stand for; where these do not end with the chunks, each is encoded by itself."""
        out = []
        for at in range(0, len(chunks), self.AT_ONCE):
            part = chunks[at:at + self.AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0].ids, self.kind)
            reached = np.cumsum(self.bytes_of[ids])
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
            after = np.searchsorted(reached, ends) + 1
            if len(ids) < after[-1] or reached[-1] != ends[-1] or (reached[after - 1] != ends).any():
                out += self._ids(part)
                continue
            flat, stops = ids.tobytes(), (after * self.width).tolist()
            out += [flat[start:stop] for start, stop in zip([0, *stops], stops)]
        return out

    def _learnt(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of distinct chunks. When too many are remembered, those not met lately go."""
        found = list(map(self.known.get, chunks))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if not missing:
            return found
        new = []
        for i in missing:
            found[i] = self.older.get(chunks[i])
            if found[i] is None:
                new.append(i)
        behind = [i for i in new if chunks[i][:1] in (b" ", b"\n")]
        others = [i for i in new if chunks[i][:1] not in (b" ", b"\n")]
        for places, encode in ((behind, self._ids_after_blank), (others, self._ids)):
            for i, ids in zip(places, encode([chunks[i] for i in places])):
                found[i] = ids
        fresh, ids = [chunks[i] for i in missing], [found[i] for i in missing]
        self.known.update(zip(fresh, ids))
        self.held += sum(map(len, fresh)) + sum(map(len, ids)) + self.ENTRY * len(fresh)
        if 2 * self.held > self.MOST:
            self.older, self.known, self.held = self.known, {}, 0
        return found

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of ``width`` bytes."""
        out, part, size = [], [], 0
        for text in texts:
            part.append(text or b"")
            size += len(part[-1])
            if size >= self.GROUP:
                out += self._encode(part)
                part, size = [], 0
        return out + self._encode(part) if part else out

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        data = b"".join(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        cuts = _cuts(data, self.kinds)
        last = np.searchsorted(cuts, ends - 1)
        # A blank that ends a text is followed by nothing.
        cuts = np.delete(cuts, last[np.append(cuts, -2)[last] == ends - 1])
        # Each text begins a chunk, an empty one too; a chunk after a cut begins with the byte at the cut.
        starts = np.append(0, ends[:-1])
        before = np.searchsorted(cuts, starts)
        offsets = np.append(np.insert(cuts, before, starts), len(data)).astype(np.int64)
        chunks = pa.Array.from_buffers(
            pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        ids = self._learnt(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
        # The ids of the distinct chunks, repeated in the order of the texts.
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        flat, which = np.frombuffer(b"".join(ids), self.kind), chunks.indices.to_numpy()
        lengths = sizes[which]
        stops = np.append(0, np.cumsum(lengths))
        places = np.repeat((np.cumsum(sizes) - sizes)[which] - stops[:-1], lengths)
        places += np.arange(len(places))
        line = flat[places].tobytes()
        bounds = (stops[np.append(before + np.arange(len(starts)), len(which))] * self.width).tolist()
        return [line[a:b] for a, b in zip(bounds, bounds[1:])]


#: One encoder a Python worker for each vocabulary: tasks that reuse the worker start with what it knows.
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder for the vocabulary file at ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _lists(flat: pa.Array, length: int) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(flat, length)


class StreamWriter:
    """Writes one partition: sequences as they fill, and the index of documents."""

    def __init__(self, files: pafs.FileSystem, path: str, kind: np.dtype, length: int, batch: int):
        self.files, self.path, self.kind, self.length, self.batch = files, path, kind, length, batch
        self.part = f"{path}.{uuid.uuid4().hex}.tmp"
        self.type = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(self.type, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = files.open_output_stream(self.part)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_docs = self.n_tokens = 0
        self.index: list[pa.RecordBatch] = []

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.out.write_batch(pa.RecordBatch.from_arrays(
            [_lists(pa.array(ids, self.type), self.length), _lists(pa.array(mask), self.length)], schema=self.schema,
        ))

    def add(self, docs: pa.Array, streams: list[np.ndarray]) -> None:
        sizes = np.array([len(s) for s in streams], np.int64)
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        self.index.append(pa.RecordBatch.from_arrays([docs, pa.array(starts), pa.array(sizes)], ["doc_id", "start", "n_tokens"]))
        self.n_docs += len(streams)
        self.n_tokens += int(sizes.sum())
        self.held += streams
        self.n_held += int(sizes.sum())
        full = self.length * self.batch
        if self.n_held >= full:
            flat = np.concatenate(self.held)
            for at in range(0, len(flat) - full + 1, full):
                self._put(flat[at:at + full], full)
            self.held = [flat[len(flat) // full * full:].copy()]
            self.n_held = len(self.held[0])

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            ids = np.zeros(-(-len(flat) // self.length) * self.length, self.kind)
            ids[: len(flat)] = flat
            self._put(ids, len(flat))
        self.out.close()
        self.sink.close()
        index = f"{self.part}.docs"
        with self.files.open_output_stream(index) as sink, pa.ipc.new_file(sink, self.index[0].schema) as out:
            for batch in self.index:
                out.write_batch(batch)
        self.files.move(index, f"{self.path}.docs")
        self.files.move(self.part, self.path)


def write_sequences(
    docs: DataFrame, folder: str, tokenizer: str, length: int = 2_048, batch: int = 64, end_id: int = 0,
    doc_id: str = "doc_id", text: str = "text",
) -> list[dict]:
    """Encode ``docs`` in the order of their ids into Arrow files under ``folder`` (a URI that all executors reach).

    Returns the manifest, a row for each file in stream order: ``path, start, n_docs, n_tokens``. It is as long as the
    number of partitions and holds no document."""
    from pyspark import TaskContext

    ordered = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn(
        "tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = encoder_of(tokenizer), None
        end = np.array([end_id], encoder.kind)
        number = TaskContext.get().partitionId()
        files, root = pafs.FileSystem.from_uri(folder)
        for whole in batches:
            for part in slices(whole):
                if writer is None:
                    files.create_dir(root, recursive=True)
                    writer = StreamWriter(files, f"{root}/part-{number:06d}.arrow", encoder.kind, length, batch)
                writer.add(part.column(0), [
                    np.concatenate([np.frombuffer(ids, encoder.kind), end]) for ids in encoder.encode(binary(part.column(1)))
                ])
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({
                "part": [number], "path": [f"{folder}/part-{number:06d}.arrow"],
                "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens],
            })

    manifest = ordered.mapInArrow(lean(write), "part bigint, path string, n_docs bigint, n_tokens bigint")
    start, out = 0, []
    for row in sorted(manifest.collect(), key=lambda r: r["part"]):  # a row for each file
        out.append({"path": row["path"], "start": start, "n_docs": row["n_docs"], "n_tokens": row["n_tokens"]})
        start += row["n_tokens"]
    return out


def open_sequences(path: str) -> tuple[pa.ipc.RecordBatchFileReader, pa.ipc.RecordBatchFileReader]:
    """Readers of a file and of its documents; local files are mapped into memory."""
    files, place = pafs.FileSystem.from_uri(path)
    local = isinstance(files, pafs.LocalFileSystem)
    one, two = ((pa.memory_map(p) if local else files.open_input_file(p)) for p in (place, f"{place}.docs"))
    return pa.ipc.open_file(one), pa.ipc.open_file(two)


def sequence(reader: pa.ipc.RecordBatchFileReader, number: int, batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a view of the file) and mask of one sequence of an opened file."""
    held = reader.get_batch(number // batch)
    ids, mask = held.column(0), held.column(1)
    length, at = ids.type.list_size, number % batch
    return (ids.flatten()[at * length:(at + 1) * length].to_numpy(),
            mask.flatten()[at * length:(at + 1) * length].to_numpy(zero_copy_only=False))


class _Stream:
    """Reads a file's real ids from front to back."""

    def __init__(self, reader: pa.ipc.RecordBatchFileReader):
        self.reader, self.batch, self.held, self.at = reader, 0, np.zeros(0, np.uint16), 0

    def take(self, n: int) -> np.ndarray:
        parts = []
        while n:
            if self.at == len(self.held):
                rows = self.reader.get_batch(self.batch)
                real = int(rows.column(1).flatten().true_count)
                self.held, self.at, self.batch = rows.column(0).flatten().to_numpy()[:real], 0, self.batch + 1
            parts.append(self.held[self.at:self.at + n])
            self.at += len(parts[-1])
            n -= len(parts[-1])
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


def read_documents(spark: SparkSession, manifest: list[dict], doc_type: str = "bigint") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone; a task reads a file."""
    schema = f"doc_id {doc_type}, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not manifest:
        return spark.createDataFrame([], schema)
    parts = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start bigint")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                ids, docs = open_sequences(path)
                stream = _Stream(ids)
                for number in range(docs.num_record_batches):
                    index = docs.get_batch(number)
                    crcs = [zlib.crc32(stream.take(n).astype("<u4").tobytes()) for n in index.column(2).to_pylist()]
                    yield pa.RecordBatch.from_arrays([
                        index.column(0), pa.array(index.column(1).to_numpy() + base), index.column(2), pa.array(crcs, pa.int64()),
                    ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return parts.repartition(len(manifest)).mapInArrow(lean(read), schema)
