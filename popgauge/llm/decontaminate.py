"""Benchmark decontamination with an FM-index per training shard.

Documents are read once, without a shuffle. A task gathers them into shards of a bounded number of words,
indexes each shard and searches all benchmark phrases in it at once: backward search through the ranks of a
wavelet matrix over the Burrows-Wheeler transform, then location by sampled suffix positions. A word that no
phrase has cannot be part of a hit, so the index holds the runs of phrase words that are long enough for the
shortest phrase, each run closed by a separator.

Words are the runs of ``[0-9a-z]`` and non-ASCII characters after A-Z are lower-cased. A phrase is ``size``
consecutive words of an item, or the whole item if it has fewer words.

Defined results: a NULL or empty text has no words and is not contaminated; an item without words has no phrase;
equal items all count; a NULL item id is written ``null``; repeated documents are judged each; empty tables give
empty results, or clean documents; columns other than those named are ignored (``contamination``) or passed
through (``decontaminated``). A text longer than a shard is a shard of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgauge.llm.common import binary, free_name, lean, slices

#: Letters and digits stay (A-Z lower-cased), other ASCII becomes a blank, non-ASCII bytes stay.
PLAIN = bytes(
    b if b >= 0x80 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 32
    for b in range(256)
)
FOUND = "array<struct<first:bigint,size:bigint,item:string>>"


def plain_words(data: bytes) -> list[bytes]:
    return data.translate(PLAIN).split()


class FmIndex:
    """FM-index of a sequence of symbols 1..sigma; a unique 0 is appended as its end."""

    def __init__(self, symbols: np.ndarray, sigma: int, every: int = 8):
        text = np.append(symbols, 0).astype(np.int64)
        order = self._suffixes(text)
        self.size = len(text)
        self.levels = max(1, int(sigma).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        row = text[order - 1]
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bits = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bits)]))
            self.zeros.append(self.size - int(self.ones[-1][-1]))
            row = np.concatenate([row[bits == 0], row[bits == 1]])
        marked = order % every == 0
        self.marks, self.mark_rank, self.samples = marked, np.cumsum(marked) - 1, order[marked]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix array by doubling the length that the ranks compare."""
        rank, width, n = text, 1, len(text)
        while True:
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1 if width < n else 0
            key = rank * (int(after.max()) + 1) + after
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            if rank[order[-1]] == n - 1:
                return order
            width *= 2

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first ``upto`` rows of the transform."""
        at, start = upto, np.zeros_like(upto)
        for depth, level in enumerate(reversed(range(self.levels))):
            up = (symbol >> level) & 1 == 1
            ones = self.ones[depth]
            at = np.where(up, self.zeros[depth] + ones[at], at - ones[at])
            start = np.where(up, self.zeros[depth] + ones[start], start - ones[start])
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols in these rows of the transform."""
        symbol = np.zeros_like(at)
        for depth in range(self.levels):
            ones = self.ones[depth]
            bit = ones[at + 1] - ones[at]
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, self.zeros[depth] + ones[at], at - ones[at])
        return symbol

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows whose suffixes begin with each phrase: (phrases found, first row, row after the last)."""
        alive = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        for column in reversed(range(phrases.shape[1])):
            symbol = phrases[alive, column]
            low = self.before[symbol] + self.rank(symbol, low)
            high = self.before[symbol] + self.rank(symbol, high)
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows: step backwards to the next sampled one."""
        found, left, rows, steps = np.zeros_like(rows), np.arange(len(rows)), rows.copy(), 0
        while len(left):
            done = self.marks[rows]
            found[left[done]] = (self.samples[self.mark_rank[rows[done]]] + steps) % self.size
            left, rows, steps = left[~done], rows[~done], steps + 1
            symbol = self.access(rows)
            rows = self.before[symbol] + self.rank(symbol, rows)
        return found


class Phrases:
    """Phrases of one block of benchmark items, as numbers of their words."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.words: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 2) for w in plain_words(text)]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                owners.setdefault(tuple(ids[i:i + size]), set()).add(item)
        self.shortest = min(map(len, owners), default=0)
        self.groups = []
        for length in sorted({len(p) for p in owners}):
            same = [p for p in owners if len(p) == length]
            self.groups.append((np.array(same, np.int64).reshape(-1, length), [sorted(owners[p]) for p in same]))

    def hits(self, shard: list[list[bytes]]) -> list[list[tuple[int, int, str]]]:
        """(first word, number of words, item) of every occurrence, for each document of the shard."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in shard]
        symbols, docs, places = [], [], []
        for number, words in enumerate(shard):
            if not self.shortest or len(words) < self.shortest:
                continue
            get = self.words.get
            ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
            known = np.concatenate([[0], (ids > 0).view(np.int8), [0]])
            edges = np.flatnonzero(np.diff(known))
            for first, after in zip(edges[::2], edges[1::2]):
                if after - first >= self.shortest:
                    symbols += [ids[first:after], [1]]
                    docs.append(np.full(after - first + 1, number))
                    places.append(np.arange(first, after + 1))
        if not symbols:
            return out
        doc, place = np.concatenate(docs), np.concatenate(places)
        index = FmIndex(np.concatenate(symbols), len(self.words) + 1)
        for phrases, owners in self.groups:
            found, low, high = index.search(phrases)
            counts = high - low
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            for phrase, at in zip(np.repeat(found, counts).tolist(), index.locate(rows).tolist()):
                for item in owners[phrase]:
                    out[doc[at]].append((int(place[at]), phrases.shape[1], item))
        return out


def shards(batches: Iterator[pa.RecordBatch], text: str, words: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[list[bytes]]]]:
    """Parts of the batches with about this many words: (rows, texts, words of each)."""
    for batch in batches:
        for part in slices(batch):
            texts = [t or b"" for t in binary(part.column(part.schema.get_field_index(text)))]
            split, start, held = [], 0, 0
            for end, data in enumerate(texts, 1):
                split.append(plain_words(data))
                held += len(split[-1])
                if held >= words or end == len(texts):
                    yield part.slice(start, end - start), texts[start:end], split
                    split, start, held = [], end, 0


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint [first, after) spans that cover the same words."""
    out: list[tuple[int, int]] = []
    for first, after in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], after))
        else:
            out.append((first, after))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans; a line break stands for each span."""
    places = [m.span() for m in re.finditer(rb"[^ \t-\r]+", data.translate(PLAIN))]
    out, at = [], 0
    for first, after in spans:
        out += [data[at:places[first][0]], b"\n"]
        at = places[after - 1][1]
    return b"".join([*out, data[at:]])


def _blocks(benchmark: DataFrame, item: str, text: str, block_items: int, block_bytes: int = 4 << 20) -> Iterator[list[tuple[str, bytes]]]:
    """The query set in blocks of about ``block_items`` rows and ``block_bytes`` bytes (a longer text is a block of its
    own), each small enough for every task and gathered when it is asked for; rows equal in item and text come once."""
    rows = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(text).cast("string").alias("words"),
    ).where("words IS NOT NULL")
    size = F.octet_length("words").cast("bigint")
    number = F.xxhash64("item", "words")
    some = rows.where(size <= block_bytes)
    total = some.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    count = max(-(-total["n"] // block_items), -(-total["bytes"] // block_bytes))
    for b in range(count):
        yield [(r["item"], r["words"].encode()) for r in some.where(F.pmod(number, F.lit(count)) == b).distinct().collect()]
    for r in rows.where(size > block_bytes).distinct().toLocalIterator():
        yield [(r["item"], r["words"].encode())]


def _searched(docs: DataFrame, benchmark: DataFrame, text: str, size: int, block_items: int, shard_words: int, column: str = "_found") -> DataFrame:
    """``docs`` with a column of all occurrences; one narrow pass for each block of items."""
    frame = docs.withColumn(column, F.expr(f"CAST(array() AS {FOUND})"))
    schema = frame.schema
    for block in _blocks(benchmark, "_item", "_phrase", block_items):
        phrases = frame.sparkSession.sparkContext.broadcast(Phrases(block, size))

        def search(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            for part, _, split in shards(batches, text, shard_words):
                at = part.schema.get_field_index(column)
                earlier = part.column(at).to_pylist()
                found = [
                    old + [{"first": f, "size": n, "item": i} for f, n, i in new]
                    for old, new in zip(earlier, phrases.value.hits(split))
                ]
                yield part.set_column(at, part.schema.field(at), pa.array(found, part.schema.field(at).type))

        frame = frame.mapInArrow(lean(search), schema)
    return frame


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    phrase: str = "text", size: int = 10, block_items: int = 5_000, shard_words: int = 200_000,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, spans (disjoint, by word), items, items_sha256``."""
    queries = benchmark.select(F.col(item_id).alias("_item"), F.col(phrase).alias("_phrase"))
    frame = _searched(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")),
        queries, "text", size, block_items, shard_words,
    )
    kind = dict(frame.dtypes)["doc_id"]
    schema = (f"doc_id {kind}, n_words bigint, n_hit bigint, spans array<struct<first:bigint,after:bigint>>, "
              "items array<string>, items_sha256 string")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, split in shards(batches, "text", shard_words):
            found = part.column(part.schema.get_field_index("_found")).to_pylist()
            spans = [merged([(f["first"], f["first"] + f["size"]) for f in one]) for one in found]
            items = [sorted({f["item"] for f in one}) for one in found]
            yield pa.RecordBatch.from_arrays([
                part.column(part.schema.get_field_index("doc_id")),
                pa.array([len(w) for w in split], pa.int64()),
                pa.array([sum(b - a for a, b in one) for one in spans], pa.int64()),
                pa.array([[{"first": a, "after": b} for a, b in one] for one in spans],
                         pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))),
                pa.array(items, pa.list_(pa.string())),
                pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
            ], ["doc_id", "n_words", "n_hit", "spans", "items", "items_sha256"])

    return frame.mapInArrow(lean(sums), schema)


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", phrase: str = "text",
    size: int = 10, block_items: int = 5_000, shard_words: int = 200_000,
) -> DataFrame:
    """The documents, all columns kept, with every benchmark occurrence cut out of ``text``."""
    queries = benchmark.select(F.col(item_id).alias("_item"), F.col(phrase).alias("_phrase"))
    found_in, columns = free_name(docs, "_found"), docs.columns
    frame = _searched(docs, queries, text, size, block_items, shard_words, found_in)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at, where = (part.schema.get_field_index(c) for c in (text, found_in))
                found = part.column(where).to_pylist()
                kept = [
                    without(data, merged([(f["first"], f["first"] + f["size"]) for f in one])).decode() if one else data and data.decode()
                    for data, one in zip(binary(part.column(at)), found)
                ]
                yield part.set_column(at, part.schema.field(at), pa.array(kept, part.schema.field(at).type)).select(columns)

    return frame.mapInArrow(lean(cut), docs.schema)
