"""Helpers the operators share: words of a text, Arrow batches in and out."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popgauge.session import shared_path

#: Native patterns of the words most contracts take: runs free of blanks.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def native_words(text: Column) -> Column:
    """Array of the words between ASCII blanks; NULL and blank texts give an empty array."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def binary(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def letters_lower(data: bytes) -> bytes:
    """A-Z lower-cased; every other byte, UTF-8 sequences too, stays."""
    return data.lower()


_IS_BLANK = np.isin(np.arange(256), list(BLANKS.encode()))


def words_in_a_row(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of the texts as one row of places in a list of words, which holds a word a few times at most: that list,
    the row, and the number of words of each text. Only words of the list become Python objects."""
    data = b"\n".join([*texts, b""])
    blank = _IS_BLANK[np.frombuffer(data, np.uint8)]
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1])) if texts else np.zeros(0, np.int64)
    # With the blanks behind it, so that each word ends where the next one begins.
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    distinct = list(map(bytes.rstrip, words.dictionary.to_numpy(zero_copy_only=False).tolist()))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return distinct, words.indices.to_numpy(), np.diff(np.searchsorted(starts, ends), prepend=0)


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; whatever else the table carries cannot clash with an operator's own."""
    return docs.select(*columns)


def _give_back() -> None:
    """Return freed memory to the system: a worker outlives its tasks, and would keep the most that any of them took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def lean(batches_of: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task function over batches that leaves its worker small."""
    @functools.wraps(batches_of)
    def run(*inputs) -> Iterator:
        try:
            yield from batches_of(*inputs)
        finally:
            _give_back()

    return run


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it, in either case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that what is derived from long texts stays small."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: the lineage ends, and the size is known."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
