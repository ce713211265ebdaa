"""Runs of repeated words, found by uniting suffix classes in the order of falling common prefixes.

A run is a stretch of words with least period q, at least ``exponent`` periods and ``least`` words long, that neither
neighbour extends. All suffixes of a text that share their first l words form a class; the classes of falling l are
what Kruskal's algorithm makes of the suffix array's neighbours, taken by falling LCP: a union-find joins two classes,
whose positions are kept in order, and the positions that become neighbours in the joined order are looked at. Two
neighbours i < j that are joined at LCP l have exactly l words in common, so the words from i to j + l have period
j - i; if the distance is within the LCP, no smaller period does (its position would stand between them), and if the
words before them differ the run starts at i. Every run is found so, at its first two periods.

Few stretches of a text can hold a run: in a run with period q each ``gram`` of words has an equal one at most q words
away, and q is at most the stretch's length over ``exponent``. Stretches where that fails are left out beforehand (by
hashes, which can only let more in), which loses no run: a run and the words beside it lie in one stretch. Texts are
independent of each other: nothing is shuffled, and a task holds the texts of one small batch.

Words are runs free of ASCII blanks, unchanged, and are compared as they are.

Defined results: NULL and blank texts have no words, no runs and an empty remaining text; repeated rows and equal ids
are judged each; NULL ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popgauge.llm.common import binary

#: A run has at least so many periods, and so many words.
EXPONENT, LEAST = 4, 6
#: Text looked at together, in bytes.
AT_ONCE = 2 << 20


def _gram(exponent: int, least: int) -> int:
    """Words of which every start in a run, but the last ones, has an equal neighbour one period on or back."""
    return min(max(least, exponent * q) - 2 * q + 1 for q in range(1, least + 1))


def stretches(ids: np.ndarray, doc: np.ndarray, exponent: int, least: int) -> list[tuple[int, int]]:
    """Where runs can lie: (first, last + 1) word of stretches that hold every run of ``ids`` and its texts' words."""
    gram = _gram(exponent, least)
    n = len(ids) - gram + 1
    if n < 2:
        return []
    mixed = doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    times = 0xD6E8FEB86659FD93
    for k in range(gram):
        mixed = mixed * np.uint64(times) + ids[k:k + n].astype(np.uint64) + np.uint64(1)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    bits = np.uint64(n.bit_length())
    place = np.arange(n, dtype=np.uint64)
    whole = doc[:n] == doc[gram - 1:]
    keys = np.sort((mixed[whole] >> bits << bits) | place[whole])  # by hash, equal ones by place
    at = (keys & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    alike = (keys[1:] >> bits) == (keys[:-1] >> bits)
    near = np.full(n, np.iinfo(np.int64).max // exponent - least)
    gap = (at[1:] - at[:-1])[alike]
    near[at[:-1][alike]] = gap
    near[at[1:][alike]] = np.minimum(near[at[1:][alike]], gap)
    keep, edges = near < len(ids), None
    while True:
        label = np.concatenate([[0], np.where(keep, doc[:n] + 1, 0), [0]])
        first = np.flatnonzero((label[1:] != label[:-1]) & (label[1:] > 0))
        last = np.flatnonzero((label[1:] != label[:-1]) & (label[:-1] > 0))
        sizes = last - first
        if edges is not None and len(edges) == len(first) and (edges == sizes).all():
            return [(int(a), int(b) + gram - 1) for a, b in zip(first, last)]
        edges, room = sizes, sizes + gram - 1
        held = np.flatnonzero(keep)
        keep[held] = (near[held] * exponent <= np.repeat(room, sizes)) & np.repeat(room >= least, sizes)


def _suffix_neighbours(ids: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in the suffix arrays of the parts of ``ids`` (``part`` rises), and how many words they share."""
    n = len(ids)
    end = np.searchsorted(part, part, "right")
    ranks = [np.unique(part.astype(np.int64) * (int(ids.max()) + 1) + ids, return_inverse=True)[1].astype(np.int32)]
    step, longest = 1, int(np.bincount(part).max())
    while step < longest and int(ranks[-1].max()) + 1 < n:
        rank = ranks[-1].astype(np.int64)
        beyond = np.arange(n) + step
        after = np.where(beyond < end, rank[np.minimum(beyond, n - 1)] + 1, 0)
        ranks.append(np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int32))
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    left, right = order[:-1], order[1:]
    inside = part[left] == part[right]
    left, right = left[inside], right[inside]
    shared = np.zeros(len(left), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        a, b = left + shared, right + shared
        fits = np.flatnonzero((a < end[left]) & (b < end[right]))
        same = fits[ranks[level][a[fits]] == ranks[level][b[fits]]]
        shared[same] += 1 << level
    return left, right, shared


def _joined(n: int, left: np.ndarray, right: np.ndarray, shared: np.ndarray, exponent: int, least: int) -> list[tuple[int, int, int]]:
    """(position, distance, LCP) of the positions that become neighbours in a joined class and can seed a run."""
    order = np.argsort(-shared, kind="stable")
    parent, members, seeds = list(range(n)), {}, []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for u, v, lcp in zip(left[order].tolist(), right[order].tolist(), shared[order].tolist()):
        u, v = find(u), find(v)
        large, small = members.pop(u, None) or [u], members.pop(v, None) or [v]
        if len(large) < len(small):
            u, v, large, small = v, u, small, large
        parent[v] = u
        most = lcp // (exponent - 1)
        before = -1
        for number, x in enumerate(small):
            at = bisect_left(large, x)
            if at and large[at - 1] != before and x - large[at - 1] <= most:
                seeds.append((large[at - 1], x - large[at - 1], lcp))
            if at < len(large) and large[at] - x <= most and (number + 1 == len(small) or small[number + 1] > large[at]):
                seeds.append((x, large[at] - x, lcp))
            large.insert(at, x)
            before = x
        members[u] = large
    return [s for s in seeds if s[1] + s[2] >= least]


def runs_of(ids: np.ndarray, doc: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the texts that ``ids`` has one after the other (``doc`` tells which)."""
    found = stretches(ids, doc, exponent, least)
    if not found:
        return []
    where = np.concatenate([np.arange(a, b) for a, b in found])
    part = np.repeat(np.arange(len(found)), [b - a for a, b in found])
    words = ids[where]
    left, right, shared = _suffix_neighbours(words, part)
    enough = shared >= _gram(exponent, least)
    seeds = _joined(len(words), left[enough], right[enough], shared[enough], exponent, least)
    out = []
    for i, distance, lcp in seeds:
        begins = i == 0 or part[i - 1] != part[i] or words[i - 1] != words[i + distance - 1]
        if begins:
            out.append((int(where[i]), distance + lcp, distance))
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows whose texts have about ``AT_ONCE`` bytes together."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def runs(
    docs: DataFrame, *, exponent: int = EXPONENT, least: int = LEAST, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, n_words, runs, kept`` of every whole text: ``runs`` is an array of ``start, length, period`` by start, then
    period, in words from 0; ``kept`` has the words, joined by a blank, that no run contains after its first period.

    ``exponent`` is a whole number of 2 or more. ``rewrite`` may change the words of a document before they are judged."""
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    frame = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows in _parts(whole):
                words = [(t or b"").split() for t in binary(rows.column(1))]
                if rewrite is not None:
                    words = [rewrite(i, w) if w else w for i, w in zip(rows.column(0).to_pylist(), words)]
                sizes = np.array([len(w) for w in words], np.int64)
                starts = np.cumsum(sizes) - sizes
                number = dict.fromkeys(chain.from_iterable(words))
                for k, w in enumerate(number):
                    number[w] = k
                ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
                doc = np.repeat(np.arange(len(words)), sizes)
                found: list[list] = [[] for _ in words]
                for start, length, period in runs_of(ids, doc, exponent, least):
                    d = int(doc[start])
                    found[d].append({"start": start - int(starts[d]), "length": length, "period": period})
                kept = []
                for mine, each in zip(found, words):
                    if mine:
                        stays = bytearray(b"\x01") * len(each)
                        for run in mine:
                            a, b = run["start"] + run["period"], run["start"] + run["length"]
                            stays[a:b] = bytes(b - a)
                        each = compress(each, stays)
                    kept.append(b" ".join(each))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(sizes), pa.array(found, pa.list_(kind)), pa.array(kept, pa.binary()).view(pa.string())],
                    ["doc_id", "n_words", "runs", "kept"])

    return frame.mapInArrow(
        judge, f"doc_id {dict(frame.dtypes)['doc_id']}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, kept string")


def greatest(column: str = "runs") -> Column:
    """The run with most periods (exactly compared); of equal ones that with the least start, then period; else NULL."""
    return F.aggregate(
        F.col(column), F.try_element_at(F.col(column), F.lit(1)),
        lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best),
    )
