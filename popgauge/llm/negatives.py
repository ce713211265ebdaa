"""Hard negatives by an inverted multi-index, exact.

The index: a vector is cut into two halves, each half has a codebook of centroids, and the pair of nearest centroids is
the vector's cell. Every row is indexed. Codebooks are fitted on ``SAMPLE`` rows at most (those with the least hash of
their id), which only decides how well cells separate, not what is found. A centroid's radius is the greatest distance
of any row's half from it, so that for a query q the half-score of any such row is at most
``q . centroid + |q| * radius``. The cells' sizes (at most ``MOST_CODES`` squared numbers) lay them out in blocks of about
``BLOCK`` rows: small cells share a block, a large one is dealt over several by a hash of its rows.

The search: for each anchor a heap walks the cells in the order of the summed bounds of their halves (the multi-sequence
algorithm) and names the blocks to look at; blocks and the anchors that want them meet in one group, where all their
scores are one matrix product. First the leading cells are looked at. What they give is a bound on what can still count,
and the walk goes on only through cells whose summed bound reaches it; the rest is certified not to matter:

* positives: the fifth best score of the anchor's label so far;
* negatives: for each positive's window ``[low, high] * score`` the fifth best score in it so far, or, while it has fewer,
  its lower end. A window whose upper end is below its lower one (a negative score) is empty and asks for nothing.

Scores are integers below 2**53, so products in floating point are exact. Anchors of a block are dealt into groups of
about ``ANCHORS``; a group holds that many anchors and a block's rows, however large the table is. Nothing of the rows or
anchors goes to the driver but the sample, the codebooks' radii and the cells' sizes.

Defined results: rows with a NULL id, label or vector, or a NULL component, take no part, nor do vectors of another
length than the most frequent one (of equally frequent ones the longest); rows equal in id, label and vector count once,
other rows of an id are rows of their own; ties go to the smaller id, then the row's hash; anchors without other rows of
their label have no result; an empty table gives an empty result; components so large that scores could not be exact are
an error; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popgauge.llm.common import lean, stored

#: Rows the codebooks are fitted on; centroids of a half at most; rows of a block; anchors of a group; rows looked at first.
SAMPLE, MOST_CODES, BLOCK, ANCHORS, FIRST = 4_096, 64, 1_024, 4_096, 4_096

ANCHOR = "anchor_id bigint, anchor_row bigint"


def codebook(half: np.ndarray, size: int, rounds: int = 8) -> np.ndarray:
    """Centroids of the rows of ``half`` (k-means from rows at even distances, the same for the same rows)."""
    distinct = np.unique(half, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(size, len(distinct))).astype(int)].astype(float)
    for _ in range(rounds):
        near = nearest(half, centres)[0]
        counts = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, half[:, d], len(centres)) for d in range(half.shape[1])], 1) if half.shape[1] else centres
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(half: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the distance to it."""
    code = np.argmin((centres ** 2).sum(1)[None, :] - 2 * half @ centres.T, axis=1)
    return code, np.sqrt(((half - centres[code]) ** 2).sum(1))


def walk(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(summed bound, first code, second code) of all cells by falling sum of their halves' bounds."""
    one, two = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap = [(-(first[one[0]] + second[two[0]]), 0, 0)] if len(one) and len(two) else []
    while heap:
        least, i, j = heapq.heappop(heap)
        yield -least, int(one[i]), int(two[j])
        if j + 1 < len(two):
            heapq.heappush(heap, (-(first[one[i]] + second[two[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(one):
            heapq.heappush(heap, (-(first[one[i + 1]] + second[two[0]]), i + 1, 0))


class MultiIndex:
    """Codebooks, radii and the layout of the cells: all that a search needs besides the rows."""

    def __init__(self, books: list[np.ndarray], cells: dict[tuple[int, int], tuple[int, float, float]], block: int):
        self.books = books
        self.radii = [np.full(len(b), -1.0) for b in books]
        self.sizes = {cell: n for cell, (n, *_) in cells.items()}
        for cell, (_, *far) in cells.items():
            for half in (0, 1):
                self.radii[half][cell[half]] = max(self.radii[half][cell[half]], far[half])
        self.blocks: dict[tuple[int, int], range] = {}
        number, room = 0, block
        for cell in sorted(cells):
            n = self.sizes[cell]
            if n > room:
                number, room = number + (room < block), block
            pieces = -(-n // block) if n > block else 1
            self.blocks[cell] = range(number, number + pieces)
            if pieces > 1:
                number, room = number + pieces, block
            else:
                room -= n

    def bounds(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each half, the greatest half-score of any row of each code."""
        out = []
        for half, q in enumerate(np.split(queries, [queries.shape[1] // 2], 1)):
            bound = q @ self.books[half].T + np.sqrt((q ** 2).sum(1))[:, None] * self.radii[half][None, :]
            out.append(np.where(self.radii[half][None, :] < 0, -np.inf, bound + 1e-6 * np.abs(bound) + 1))
        return out

    def visits(self, first: np.ndarray, second: np.ndarray, rows: int, least: float | None) -> list[int]:
        """Blocks to look at: those of the leading cells (``rows`` rows or a little more), or, with ``least``, the others
        whose bound reaches it."""
        seen, later, held = set(), [], 0
        for bound, i, j in walk(first, second):
            if held >= rows and (least is None or bound < least):
                break
            if (i, j) not in self.blocks:
                continue
            if held < rows:
                held += self.sizes[i, j]
                seen.update(self.blocks[i, j])
            elif not seen.issuperset(self.blocks[i, j]):
                later += [b for b in self.blocks[i, j] if b not in seen]
        return sorted(seen) if least is None else sorted(set(later))


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), size)


def _best(scores: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``n`` greatest allowed scores of each row, ties to the smaller column."""
    shown = np.where(allowed, scores, -np.inf)
    if shown.shape[1] > n:
        least = np.partition(shown, shown.shape[1] - n, axis=1)[:, shown.shape[1] - n]
        allowed = allowed & (shown >= least[:, None])
    row, column = np.nonzero(allowed)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    start = np.searchsorted(row, row, "left")
    top = np.arange(len(row)) - start < n
    return row[top], column[top]


def _usable(rows: DataFrame) -> DataFrame:
    whole = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL)")
    sizes = whole.groupBy(F.size("vector").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.expr("aggregate(vector, 0D, (m, x) -> greatest(m, abs(cast(x AS double))))")).alias("most"))
    found = sizes.orderBy(F.desc("n"), F.desc("size")).head(1)  # one row
    size, most = (found[0]["size"], found[0]["most"]) if found else (0, 0)
    if size * most ** 2 >= 2 ** 53:
        raise ValueError(f"scores of {size} components up to {most} are not exact")
    alike = whole.where(F.size("vector") == size).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.col("vector").cast("array<int>").alias("vector"),
    ).distinct()
    return alike.withColumn("row", F.xxhash64("label", "vector"))


def index(rows: DataFrame, block: int = BLOCK, sample: int = SAMPLE) -> tuple[DataFrame, MultiIndex | None]:
    """All usable rows with their ``block`` (stored), and the index; none of an empty table."""
    points = stored(_usable(rows), "negatives-points")
    n = points.count()
    if not n:
        return points, None
    picked = points.orderBy(F.xxhash64("vec_id", "row"), "vec_id", "row").limit(sample).select("vector").toArrow()
    size = len(picked["vector"][0])
    vectors = _matrix(picked["vector"], size)
    codes = min(MOST_CODES, max(4, int((n / 512) ** 0.5)))
    books = [codebook(half, codes) for half in np.split(vectors, [size // 2], 1)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                halves = np.split(_matrix(pa.chunked_array([batch.column("vector")]), size), [size // 2], 1)
                (one, far_one), (two, far_two) = (nearest(h, b) for h, b in zip(halves, books))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array(c.astype(np.int32)) for c in (one, two)), pa.array(far_one), pa.array(far_two)],
                    [*batch.schema.names, "one", "two", "far_one", "far_two"])

    schema = "vec_id bigint, label bigint, vector array<int>, row bigint, one int, two int, far_one double, far_two double"
    placed = stored(points.select("vec_id", "label", "vector", "row").mapInArrow(lean(place), schema), "negatives-cells")
    sizes = placed.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), F.max("far_one").alias("a"), F.max("far_two").alias("b"))
    found = {(r["one"], r["two"]): (r["n"], r["a"], r["b"]) for r in sizes.collect()}  # MOST_CODES squared rows at most
    made = MultiIndex(books, found, block)
    layout = placed.sparkSession.createDataFrame(
        [(i, j, b.start, len(b)) for (i, j), b in made.blocks.items()], "one int, two int, start int, pieces int")
    laid = placed.join(F.broadcast(layout), ["one", "two"]).select(
        "vec_id", "label", "vector", "row", (F.col("start") + F.pmod(F.xxhash64("vec_id", "row"), "pieces")).cast("int").alias("block"))
    return laid, made


def _looked_at(anchors: DataFrame, rows: DataFrame, made: MultiIndex, size: int, groups: int, first: int, n: int,
               low: int, high: int, windows: bool, again: bool) -> DataFrame:
    """The best rows of the blocks that each anchor visits: ``anchor_id, anchor_row, window, vec_id, row, score``.

    ``again``: the blocks after the leading ones, down to the anchor's ``least``. ``windows``: negatives in the windows of
    the anchor's ``scores``; otherwise positives, in window 0."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                bounds = made.bounds(_matrix(pa.chunked_array([batch.column("vector")]), size))
                least = batch.column("least").to_pylist()
                named = [made.visits(a, b, first, t if again else None) for a, b, t in zip(*bounds, least)]
                take = pa.array(np.repeat(np.arange(batch.num_rows), [len(v) for v in named]))
                wide = batch.take(take)
                yield pa.RecordBatch.from_arrays([*wide.columns, pa.array([b for v in named for b in v], pa.int32())], [*wide.schema.names, "block"])

    part = F.pmod(F.xxhash64("anchor_id", "anchor_row"), F.lit(groups)).cast("int").alias("part")
    wanted = anchors.select("anchor_id", "anchor_row", "label", "vector", "scores", "least", part).mapInArrow(
        spread, f"{ANCHOR}, label bigint, vector array<int>, scores array<bigint>, least double, part int, block int")
    dealt = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    schema = pa.schema([("anchor_id", pa.int64()), ("anchor_row", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            left = left.sort_by([("vec_id", "ascending"), ("row", "ascending")])
            ids, own, labels = (left[c].to_numpy() for c in ("vec_id", "row", "label"))
            vectors = _matrix(left["vector"], size)
            for at in range(0, right.num_rows, 512):
                some = right.slice(at, 512)
                scores = _matrix(some["vector"], size) @ vectors.T
                anchor, anchor_row, label = (some[c].to_numpy() for c in ("anchor_id", "anchor_row", "label"))
                same = label[:, None] == labels[None, :]
                if windows:
                    held = some["scores"].to_pylist()
                    for window in range(max(map(len, held))):
                        upper = np.array([h[window] if window < len(h) else -1 for h in held], float)[:, None]
                        inside = ~same & (upper >= 0) & (low * upper <= 100 * scores) & (100 * scores <= high * upper)
                        out.append((window, *_best(scores, inside, n), scores, anchor, anchor_row))
                else:
                    other = (anchor[:, None] != ids[None, :]) | (anchor_row[:, None] != own[None, :])
                    out.append((0, *_best(scores, same & other, n), scores, anchor, anchor_row))
        parts = [pa.Table.from_arrays([pa.array(x) for x in (a[i], r[i], np.full(len(i), w, np.int32), ids[j], own[j], s[i, j].astype(np.int64))], schema=schema)
                 for w, i, j, s, a, r in out]
        return pa.concat_tables(parts) if parts else schema.empty_table()

    met = dealt.groupBy("block", "part").cogroup(wanted.groupBy("block", "part"))
    return met.applyInArrow(score, f"{ANCHOR}, window int, vec_id bigint, row bigint, score bigint")


def _top(found: DataFrame, n: int) -> DataFrame:
    best = Window.partitionBy("anchor_id", "anchor_row", "window").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def mine(
    rows: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    block: int = BLOCK, first: int = FIRST, anchors_per_group: int = ANCHORS, sample: int = SAMPLE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``rows`` (``vec_id, label, vector`` of whole
    numbers): for each anchor and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other
    labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``."""
    spark = rows.sparkSession
    placed, made = index(rows, block, sample)
    if made is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    placed = stored(placed, "negatives-index")
    size = sum(b.shape[1] for b in made.books)
    asked = stored(placed.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), F.col("row").alias("anchor_row"), "label", "vector"), "negatives-anchors")
    groups = max(1, -(-asked.count() // anchors_per_group))
    key = ["anchor_id", "anchor_row"]

    def look(anchors: DataFrame, windows: bool, again: bool) -> DataFrame:
        return _looked_at(anchors, placed, made, size, groups, first, negatives if windows else positives, low, high, windows, again)

    # Positives: the leading cells, then those that can still hold one of the best.
    none = F.array().cast("array<bigint>")
    seeds = stored(_top(look(asked.select("*", none.alias("scores"), F.lit(None).cast("double").alias("least")), False, False), positives), "negatives-seeds")
    fifth = seeds.where(F.col("rank") == positives).select(*key, F.col("score").cast("double").alias("least"))
    open_ended = asked.join(fifth, key, "left").select("*", none.alias("scores")).fillna({"least": float("-inf")})
    best = stored(_top(seeds.drop("rank").unionByName(look(open_ended, False, True)), positives), "negatives-positives")
    told = best.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda e: e["score"]).alias("scores"))
    # Negatives: the leading cells, then those that reach a window's fifth score or, if it has fewer, its lower end.
    aiming = asked.join(told, key).withColumn("least", F.lit(None).cast("double"))
    near = stored(_top(look(aiming, True, False), negatives), "negatives-near")
    full = near.where(F.col("rank") == negatives).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("full"))
    ends = F.transform("scores", lambda s, w: F.when(s >= 0, F.coalesce(F.try_element_at("full", w).cast("double"), s * (low / 100.0))))
    still = asked.join(told, key).join(full, key, "left").withColumn("least", F.array_min(ends)).where("least IS NOT NULL")
    hard = _top(near.drop("rank").unionByName(look(still, True, True)), negatives)
    chosen = best.select(*key, (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(chosen, [*key, "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
