"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Every document gives a vector of statistics of its whole text. Standardised, they pass through random Fourier
features, whose inner products approximate a Gaussian kernel. Partitions of the labelled rows sum their parts of the
normal equations, Spark adds the parts, and the ridge solution scores all documents. Scores of labelled rows that
took no part in the fit are counted on a fixed grid, and pooling adjacent violators turns the grid's shares into
calibrated probabilities.

Labels come from at most ``most_rows`` rows (the least by a hash of the id) whose id's CRC-32 modulo 5 is not 0; one
of the other four residues calibrates, three fit. Label, language, source and id never enter a score.

Defined results: NULL texts score like empty ones; documents with a NULL id are scored and never held out, and lend
no label; NULL labels are ignored; of repeated labels of one id the mean decides, 0.5 counting as 1; repeated rows are
scored each; without any usable label every score is 0.5; empty tables give empty results; other columns are
ignored (``scores``) or passed through (``accepted``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popgauge.llm.common import binary, lean, slices
from popgauge.session import cut_lineage

#: Grid of raw scores for calibration.
CELLS = 512
THRESHOLD = 0.3

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_MARKS = b"#*$%&|<>"
_STOPS = b".,;:!?"
_BLANK = b" \t\n\x0b\x0c\r"
_HIGH = bytes(range(128, 256))


def _count(data: bytes, those: bytes) -> int:
    return len(data) - len(data.translate(None, those))


def statistics(data: bytes) -> list[float]:
    """Statistics of a whole text; shares are smoothed so that short texts are not extreme."""
    words = data.split()
    n, size = len(words), len(data) - _count(data, _BLANK)
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    lines = [line for line in data.split(b"\n") if line.strip()]
    sentences = data.count(b".") + data.count(b"!") + data.count(b"?")
    upper, lower = _count(data, _UPPER), _count(data, _LOWER)
    marks = _count(data, _MARKS)
    ended = sum(line.rstrip().endswith((b".", b"!", b"?")) for line in lines)
    share = lambda part, whole, prior=20.0: part / (whole + prior)
    return [
        np.log1p(n), np.log1p(size), float(lengths.mean()), float(lengths.std()),
        np.sqrt(share(upper, size)), share(lower, size), np.sqrt(share(_count(data, _DIGIT), size)),
        np.sqrt(share(marks, size)), np.sqrt(share(data.count(b"|"), n)), np.sqrt(share(data.count(b"!"), n)),
        np.sqrt(share(_count(data, _STOPS), size)), share(_count(data, _HIGH), size),
        share(len(set(words)), n), np.sqrt(share(len(lines) - len(set(lines)), len(lines), 4.0)),
        np.log1p(n / (sentences + 1)), np.log1p(n / max(1, len(lines))), share(ended, len(lines), 1.0),
        float((lengths == 1).mean()), float((lengths > 12).mean()),
    ]


SIZE = len(statistics(b""))


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, x`` (array of doubles) of every document."""
    frame = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [statistics(data or b"") for data in binary(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return frame.mapInArrow(lean(take), f"doc_id {dict(frame.dtypes)['doc_id']}, x array<double>")


def _residue(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


@dataclass
class Model:
    """Standardisation, random frequencies, ridge weights and calibration knots."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6.0, 6.0)
        waves = np.sqrt(2.0 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, 0.0, 1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated share; a hundredth of the raw score keeps the order inside a calibrated step."""
        raw = self.raw(x)
        return 0.99 * np.interp(raw, self.knots, self.levels) + 0.01 * raw


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def pooled(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Weighted isotonic fit: pool adjacent violators."""
    blocks: list[list[float]] = []
    for w, m in zip(weights, means):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2]
    return np.concatenate([np.full(n, m) for _, m, n in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame, most_rows: int = 200_000, waves: int = 300, ridge: float = 1e-3,
        width: float = 6.0, seed: int = 17) -> Model:
    """Fit on ``stats`` (``doc_id, x``) and ``labels`` (``doc_id, quality``)."""
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("double").alias("y")).withColumn("part", _residue("doc_id")).where("part != 0")
    order = F.xxhash64("doc_id")
    cut = marked.count() / most_rows
    if cut > 1:  # the documented bound: the least hashes, as a share of the hash range, then exactly
        marked = marked.where(order < F.lit(int(-(2 ** 63) + 2 ** 64 / cut))).orderBy(order).limit(most_rows)
    known = stats.where("doc_id IS NOT NULL").join(marked, "doc_id")
    rows = cut_lineage(known.repartition(16, F.xxhash64("doc_id")).select("x", "y", "part"))
    moments = rows.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(SIZE) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(SIZE)])
    scale = np.array([max(moments[f"s{i}"] or 0.0, 1e-3) for i in range(SIZE)])
    random = np.random.default_rng(seed)
    model = Model(mean, scale, random.normal(size=(SIZE, waves)) / width * np.sqrt(2.0), random.uniform(0, 2 * np.pi, waves),
                  np.append(np.zeros(waves), 0.5), np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = waves + 1
        left, right, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            f, y = model.features(_rows(batch.column(0))), batch.column(1).to_numpy()
            weight = np.where(y == 1.0, 1.0, 3.0)[:, None]  # bad documents are few
            left += f.T @ (f * weight)
            right += (f * weight).T @ y
            n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array(np.hstack([left, right[:, None]]).tolist(), pa.list_(pa.float64()))],
                ["i", "v"])

    fitting = rows.where("part != 1").select("x", "y")
    parts = fitting.mapInArrow(lean(normal), "i int, v array<double>")
    summed = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")) \
        .groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("row"))
    lines = sorted(summed.select("i", F.col("row.v").alias("v")).collect(), key=lambda r: r["i"])  # waves + 1 rows
    if not lines:
        return model
    system = np.array([r["v"] for r in lines])
    total = system[-1, waves]
    model.weights = np.linalg.solve(system[:, :-1] + ridge * total * np.eye(waves + 1) / waves, system[:, -1])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.minimum((model.raw(_rows(batch.column(0))) * CELLS).astype(np.int32), CELLS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["cell", "y"])

    grid = rows.where("part = 1").select("x", "y").mapInArrow(lean(cells), "cell int, y double").groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("share")).orderBy("cell").collect()  # CELLS rows at most
    if grid:
        model.knots = np.array([(r["cell"] + 0.5) / CELLS for r in grid])
        model.levels = pooled(np.array([r["n"] for r in grid], float), np.array([r["share"] for r in grid]))
    else:
        model.levels = model.knots.copy()
    return model


def scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    stats = cut_lineage(document_statistics(docs, doc_id, text))
    model = fit(stats, labels, **options)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.score(_rows(batch.column(1))), pa.float64())], ["doc_id", "score"])

    return stats.mapInArrow(lean(score), f"doc_id {dict(stats.dtypes)['doc_id']}, score double").select(
        "doc_id", F.coalesce(_residue("doc_id") == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns kept, whose score reaches the threshold."""
    model = fit(document_statistics(docs, doc_id, text), labels, **options)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = np.array([statistics(data or b"") for data in binary(part.column(at))])
                yield part.filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(lean(keep), docs.schema)
