"""Substring deduplication with suffix automata of reference shards.

Every run of ``window`` consecutive words that starts anywhere else in the corpus, in the same document included, is
a repeat; each word that a repeat covers is removed, in all places.

Two equal windows have the same least ``ANCHOR``-word run, their anchor (by hash; the first of equal ones). Windows
in a row that share one anchor form a piece of at most ``window + reach - 1`` words, and equal windows always lie in
pieces with equal anchors. Anchors are counted; only pieces whose anchor occurs twice go on. Distinct pieces, each
with its number of occurrences, are the reference: they are sorted into shards by anchor, each shard becomes a
generalised suffix automaton whose states know how often their strings occur, and the pieces stream through the
automaton of their shard. Matching statistics and counts tell the repeated windows of a piece; they go back to every
document that holds the piece, where overlapping windows merge into maximal spans.

A shard's automaton goes only to the task whose pieces can match it; a broadcast would send every shard to every
task, and neither their number nor their size has a bound. Anchors that are very frequent (at most 2**20 can be, a
list of bounded size that is broadcast) do not gather their pieces: there each window is a piece of its own, and its
anchor is the whole window, so that a passage with many different neighbours never meets in one automaton.

Words are runs free of ASCII blanks, unchanged.

Defined results: NULL and blank texts have no words; texts shorter than a window have no repeats; repeated rows are
repeats of each other; NULL ids are ids; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgauge.llm.common import binary, lean, slices, stored, words_in_a_row

#: Words of an anchor (a power of two), and occurrences from which an anchor counts as very frequent.
ANCHOR, FREQUENT = 16, 4_096
#: Words of one automaton, and words cut into pieces at once, about.
SHARD_WORDS, LOT = 60_000, 16_384
WIDTH = 6  # bytes of a word's number inside pieces

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as long as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                line = np.full(size, base, np.uint64)
                line[0] = 1
                setattr(self, name, np.cumprod(line, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every word of the texts, in a row, and the number of words of each text."""
    distinct, which, sizes = words_in_a_row(texts)
    return np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))[which], sizes


class Pieces:
    """Pieces of several documents, whose words stand in a row: ``text``, ``start`` in it, number of windows ``count``,
    ``anchor`` and ``piece`` hashes."""

    def __init__(self, x: np.ndarray, sizes: np.ndarray, window: int, frequent: np.ndarray):
        ends = np.cumsum(sizes)
        whole = np.ones(max(0, len(x) - window + 1), bool)  # windows of one document
        for end in ends[:-1].tolist():
            whole[max(0, end - window + 1):end] = False
        windows = np.flatnonzero(whole)
        if not len(windows):
            self.text = self.start = self.count = np.zeros(0, np.int64)
            self.anchor = self.piece = np.zeros(0, np.uint64)
            return
        run, width = _mixed(x), 1
        while width < ANCHOR:
            run = _mixed(run[:-width] * np.uint64(_BASE) + run[width:])
            width *= 2
        reach = window - ANCHOR + 1
        value, place, span = run, np.arange(len(run)), 1
        while span < reach:
            shift = min(span, reach - span)
            later = value[shift:] < value[:-shift]
            place = np.where(later, place[shift:], place[:-shift])
            value = np.where(later, value[shift:], value[:-shift])
            span += shift
        # Windows of two documents have no anchor in common.
        place = place[windows]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.append(first, len(windows)))
        anchor, first = run[place[first]], windows[first]
        if len(frequent):
            hot = frequent[np.minimum(np.searchsorted(frequent, anchor), len(frequent) - 1)] == anchor
            if hot.any():
                alone = np.where(hot, count, 1)
                first = np.repeat(first, alone) + np.arange(alone.sum()) - np.repeat(np.cumsum(alone) - alone, alone)
                count = np.where(np.repeat(hot, alone), 1, np.repeat(count, alone))
                anchor, hot = np.repeat(anchor, alone), np.repeat(hot, alone)
        up, down = _powers.upto(len(x) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(x * up[:-1], dtype=np.uint64)])
        after = first + count + window - 1
        self.piece = _mixed((sums[after] - sums[first]) * down[first] + count.astype(np.uint64) * np.uint64(_BASE))
        if len(frequent) and hot.any():
            anchor = np.where(hot, self.piece, anchor)
        self.text = np.searchsorted(ends, first, side="right")
        self.start, self.count, self.anchor = first - (ends - sizes)[self.text], count, anchor


def lots(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbours of about ``most`` words together; a larger text alone or at the end."""
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
        yield slice(a, b)


class Automaton:
    """Generalised suffix automaton over sequences of numbers, with weighted occurrence counts."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of ``q`` for the shorter strings that ``p`` reaches."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int], weight: int) -> None:
        last, moves, link, length = 0, self.next, self.link, self.length
        for word in words:
            q = moves[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
            else:
                new = self._state(length[last] + 1, {}, 0)
                p = last
                while p != -1 and word not in moves[p]:
                    moves[p][word] = new
                    p = link[p]
                if p != -1:
                    q = moves[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                last = new
            self.count[last] += weight

    def close(self) -> None:
        """Add each state's occurrences to the states of its suffixes."""
        for state in np.argsort(np.array(self.length))[:0:-1].tolist():
            self.count[self.link[state]] += self.count[state]

    def repeats(self, words: list[int], window: int) -> int:
        """Bit i: the window that starts at word i occurs twice or more. Streams the words through the automaton and
        keeps the state of the last ``window`` words."""
        state, out, moves, link, length = 0, 0, self.next, self.link, self.length
        for i, word in enumerate(words):
            state = moves[state][word]
            while length[link[state]] >= window:
                state = link[state]
            if i >= window - 1 and self.count[state] >= 2:
                out |= 1 << i - window + 1
        return out


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, row, text``: equal rows share ``row``."""
    frame = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return frame.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def _pieces(texts: DataFrame, window: int, frequent, only: bool = False) -> DataFrame:
    """``anchor, row, place, piece`` of ``row, text``; ``place`` packs start and number of windows. ``only``: just the
    pieces of very frequent anchors."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        for batch in batches:
            for part in slices(batch, 256):
                rows, (x, sizes), held = part.column(0).to_numpy(), word_numbers(binary(part.column(1))), []
                ends = np.cumsum(sizes)
                for some in lots(sizes, LOT):
                    p = Pieces(x[ends[some][0] - sizes[some][0]:ends[some][-1]], sizes[some], window, hot)
                    keep = p.anchor == p.piece if only else slice(None)
                    held.append((p.anchor[keep], rows[some][p.text[keep]], (p.start << 8 | p.count)[keep], p.piece[keep]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).view(np.int64)) for c in zip(*held)], ["anchor", "row", "place", "piece"])

    return texts.mapInArrow(lean(cut), "anchor bigint, row bigint, place bigint, piece bigint")


def _packed(keyed: DataFrame) -> DataFrame:
    """The texts compressed, to be shuffled."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([squeeze(t) for t in binary(part.column(2))], pa.binary())],
                    ["doc_id", "row", "packed"])

    return keyed.mapInArrow(lean(pack), f"doc_id {dict(keyed.dtypes)['doc_id']}, row bigint, packed binary")


def _unpacked(column: pa.Array) -> list[bytes]:
    return list(map(zstandard.ZstdDecompressor().decompress, column.to_pylist()))


def _references(pieces: DataFrame, packed: DataFrame, window: int) -> DataFrame:
    """``anchor, piece, n, words`` of every distinct piece: its words from one document that has it."""
    one = pieces.groupBy("anchor", "piece").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "place")).alias("at"))
    by_row = one.groupBy(F.col("at.row").alias("row")).agg(F.collect_list(F.struct(F.col("at.place").alias("place"), "anchor", "piece", "n")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64):
                out: list[tuple] = []
                x, sizes = word_numbers(_unpacked(part.column(1)))
                raw = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()
                for wanted, before in zip(part.column(0).to_pylist(), (np.cumsum(sizes) - sizes).tolist()):
                    for w in wanted:
                        start, count = before + (w["place"] >> 8), w["place"] & 255
                        out.append((w["anchor"], w["piece"], w["n"], raw[start * WIDTH:(start + count + window - 1) * WIDTH]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    ["anchor", "piece", "n", "words"])

    return by_row.join(packed.select("row", "packed"), "row").select("wanted", "packed").mapInArrow(
        cut, "anchor bigint, piece bigint, n bigint, words binary")


def _judged(references: DataFrame, window: int) -> DataFrame:
    """``anchor, piece, repeats`` (bits by window) of the pieces with repeats: automata by shard of whole anchors."""
    def shard(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        automaton = Automaton()
        texts = []
        for _, _, n, raw in held:
            wide = np.zeros((len(raw) // WIDTH, 8), np.uint8)
            wide[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
            texts.append(wide.view("<u8")[:, 0].tolist())
            automaton.add(texts[-1], n)
        automaton.close()
        found = [automaton.repeats(words, window) for words in texts]
        rows = [(a, p, bits) for (a, p, _, _), bits in zip(held, found) if bits]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["anchor", "piece", "repeats"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD_WORDS and row[0] != held[-1][0]:
                    yield shard(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) // WIDTH
        if held:
            yield shard(held)

    return references.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        stream, "anchor bigint, piece bigint, repeats bigint")


def _removal(window: int):
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                sizes, gone, digests, spans = [], [], [], []
                for data, found in zip(_unpacked(part.column(1)), part.column(2).to_pylist()):
                    words = data.split()
                    edge = np.zeros(len(words) + 1, np.int32)
                    for one in found or ():
                        start, bits = one["start"], one["repeats"]
                        while bits:
                            low = (bits & -bits).bit_length() - 1
                            edge[start + low] += 1
                            edge[start + low + window] -= 1
                            bits &= bits - 1
                    removed = np.cumsum(edge[:-1]) > 0
                    kept = [w for w, r in zip(words, removed.tolist()) if not r] if removed.any() else words
                    sizes.append(len(words))
                    gone.append(len(words) - len(kept))
                    digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    cuts = np.flatnonzero(np.diff(np.concatenate([[0], removed.view(np.int8), [0]]))).reshape(-1, 2)
                    spans.append([{"first": a, "after": b} for a, b in cuts.tolist()])
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))),
                ], ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])
    return take


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans`` (removed, by word) of every document."""
    if not ANCHOR < window <= ANCHOR + 62:
        raise ValueError(f"window must be between {ANCHOR + 1} and {ANCHOR + 62} words")
    context = docs.sparkSession.sparkContext
    keyed = _keyed(docs, doc_id, text)
    texts = keyed.select("row", "text")
    every = stored(_pieces(texts, window, context.broadcast(np.zeros(0, np.uint64))), "substring-pieces")
    met = stored(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "substring-anchors")
    total = met.agg(F.sum("n")).first()[0] or 0
    most = max(FREQUENT, total >> 20)
    # Not more than total / most, that is 2**20, anchors can have over ``most`` of ``total`` occurrences.
    hot = np.sort(np.array([r["anchor"] for r in met.where(F.col("n") > most).select("anchor").collect()], np.int64).view(np.uint64))
    frequent = F.broadcast(met.where(F.col("n") > most).select("anchor"))  # so the same bound holds
    rare = every.join(frequent, "anchor", "left_anti") if len(hot) else every  # their rows would meet in a few tasks
    pieces = rare.join(met.where(F.col("n") <= most).select("anchor"), "anchor")
    if len(hot):
        alone = stored(_pieces(texts, window, context.broadcast(hot), only=True), "substring-windows")
        twice = alone.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        pieces = pieces.unionByName(alone.join(twice.select("anchor"), "anchor"))
    pieces = stored(pieces, "substring-met")  # columns, compressed: a checkpoint would hold whole rows
    packed = _packed(keyed)
    found = _judged(_references(pieces, packed, window), window)
    by_row = pieces.join(found, ["anchor", "piece"]).select("row", F.shiftright("place", 8).alias("start"), "repeats").distinct() \
        .groupBy("row").agg(F.collect_list(F.struct("start", "repeats")).alias("found"))
    kind = dict(keyed.dtypes)["doc_id"]
    return packed.join(by_row, "row", "left").select("doc_id", "packed", "found").mapInArrow(
        _removal(window),
        f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<first:bigint,after:bigint>>")
