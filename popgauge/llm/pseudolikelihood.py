"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, scores documents.

Each token is predicted from the words on both sides of it, itself masked. The words around it (``SIDE`` on each)
choose vectors from one table per position; their sum passes through tanh and a softmax over word classes. A class
is one of the most frequent words, a band of less frequent ones (bands of about equal mass, so that words of one band
are about equally frequent), or all words outside the list; inside a class a word has its share of the class's
occurrences in the corpus. A document's score is the sum of the conditional log-probabilities of its tokens.

Word counts cover the whole corpus and are summed by Spark. Training goes over every document once: a hash of id and text
deals the documents into ``rounds`` parts; in each round Spark sums the gradients of one part over all partitions, and
the parameters take one step along them (rates that follow the gradients' moments). The bias starts at the classes'
shares, so training starts from the word frequencies. Gradients are sums, so the model does not depend on how the table
is partitioned, but for the rounding of sums; nothing is gathered in one place but these sums, whose size is fixed.

Words are runs free of ASCII blanks, A-Z lower-cased.

Defined results: NULL and blank texts have no tokens, the sum 0 and a NULL mean; the edges of a text are a word of
their own; repeated rows are scored each; NULL ids are ids; an empty corpus gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgauge.llm.common import binary, lean, letters_lower, slices, words_in_a_row
from popgauge.session import cut_lineage

#: Frequent words that are classes, classes in all, words with an input vector, hidden units, window on each side.
FREQUENT, CLASSES, VOCABULARY, HIDDEN, SIDE = 40, 64, 4_096, 16, 2
#: Words with an input vector of their own, and words whose counts are broadcast; the others' counts stay distributed.
OWN, LISTED = 2_048, 32_768
#: Class of the words outside the list.
UNLISTED = CLASSES - 1
OFFSETS = (*range(-SIDE, 0), *range(1, SIDE + 1))
#: Tokens of one forward pass, and of one sum of gradients by row.
STEP, LOT = 8_192, 65_536
#: Size of a step, and what the gradients' mean and mean square keep of their past.
RATE, KEEP_MEAN, KEEP_SQUARE = 0.1, 0.8, 0.9


class Lexicon:
    """Row (of the input tables), class and log share (of the word in its class) of every word."""

    def __init__(self, listed: list[tuple[bytes, int]], total: int | None = None):
        """``listed``: words and counts by falling count; ``total``: tokens of the corpus, those of other words too."""
        self.listed = {w: (i, n) for i, (w, n) in enumerate(listed)}
        counts = np.array([n for _, n in listed], np.int64)
        self.total = int(counts.sum()) if total is None else total
        banded = counts[FREQUENT:]
        middle = (np.cumsum(banded) - banded / 2) / max(1, banded.sum())
        bands = FREQUENT + (middle * (UNLISTED - FREQUENT)).astype(np.int64)
        self.placed = np.concatenate([np.arange(min(FREQUENT, len(counts))), bands]).astype(np.int64)
        totals = np.zeros(CLASSES, np.int64)
        np.add.at(totals, self.placed, counts)
        totals[UNLISTED] = self.total - counts.sum()
        self.totals, self.placed = totals.tolist(), self.placed.tolist()
        # By place in the list; the last entry is of all other words, whose rows are found by hash.
        self.place = {w: i for i, (w, _) in enumerate(listed)}
        self.rows = np.array([self._row(i, w) for i, (w, _) in enumerate(listed)] + [0], np.int32)
        self.classes = np.array([*self.placed, UNLISTED], np.int32)
        # One more stands for words never seen; ``scored`` adds the logarithm of the word's count.
        self.shares = np.array(
            [math.log(n / self.totals[c]) for (_, n), c in zip(listed, self.placed)] + [-math.log(self.totals[UNLISTED] + 1.0)])

    @staticmethod
    def _row(at: int, word: bytes) -> int:
        """Row 0 is the edge of a text; words without a row of their own share one by hash."""
        return at + 1 if at < OWN else 1 + OWN + (xxhash.xxh64_intdigest(word, 7) >> 32) % (VOCABULARY - OWN)

    def class_of(self, word: bytes) -> int:
        return self.placed[self.listed[word][0]] if word in self.listed else UNLISTED

    def log_shares(self) -> np.ndarray:
        """Logarithm of each class's share of all tokens; half an occurrence more stands for what was never seen."""
        totals = np.array(self.totals, np.float64) + 0.5
        return np.log(totals / totals.sum())

    def __reduce__(self):
        return Lexicon, ([(w, n) for w, (_, n) in self.listed.items()], self.total)

    def numbers(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input rows, classes and log shares of the words."""
        other = len(self.place)
        places = np.fromiter(map(self.place.get, words, repeat(other)), np.int64, len(words))
        rows, others = self.rows[places], np.flatnonzero(places == other)
        rows[others] = [self._row(VOCABULARY, words[i]) for i in others.tolist()]
        return rows, self.classes[places], self.shares[places]


def start(seed: int = 5) -> list[np.ndarray]:
    """Input tables (position, word, unit), output weights and bias. Row 0 stands for the edge of a text."""
    random = np.random.default_rng(seed)
    return [
        random.normal(0, 0.1, (len(OFFSETS), VOCABULARY + 1, HIDDEN)).astype(np.float32),
        random.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32), np.zeros(CLASSES, np.float32),
    ]


def laid(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Several texts on one line with edges (row 0) between them, and the places of their tokens."""
    gap = np.zeros(SIDE, np.int32)
    line = np.concatenate([gap, *[part for r in rows for part in (r, gap)]])
    starts = np.cumsum([SIDE] + [len(r) + SIDE for r in rows[:-1]])
    at = np.concatenate([np.arange(len(r)) + s for r, s in zip(rows, starts)]) if rows else np.zeros(0, np.int64)
    return line, at


def windows(rows: list[np.ndarray]) -> np.ndarray:
    """Input rows around every token of several texts: (tokens, positions)."""
    line, at = laid(rows)
    return np.stack([line[at + o] for o in OFFSETS], axis=1)


def forward(model: list[np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hidden units, logits of the classes less their greatest, and their exponentials."""
    tables, out, bias = model
    hidden = tables[0].take(around[:, 0], axis=0)
    for p in range(1, len(OFFSETS)):
        hidden += tables[p].take(around[:, p], axis=0)
    np.tanh(hidden, out=hidden)
    logits = hidden @ out
    logits += bias
    logits -= logits.max(axis=1, keepdims=True)
    return hidden, logits, np.exp(logits)


def log_probabilities(model: list[np.ndarray], around: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Log-probability of each token's class given the words around it."""
    _, logits, weights = forward(model, around)
    return logits[np.arange(len(classes)), classes] - np.log(weights.sum(axis=1))


def gradients(model: list[np.ndarray], around: np.ndarray, classes: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean loss by hidden input, output weights and bias."""
    hidden, _, error = forward(model, around)
    n = len(classes)
    error /= error.sum(axis=1, keepdims=True)
    error[np.arange(n), classes] -= 1.0
    error /= n
    back = error @ model[1].T
    back *= 1.0 - hidden * hidden
    return [back, hidden.T @ error, error.sum(axis=0)]


class Gradients:
    """Sums of the gradients over the tokens of many texts: by position and input row, output weights and bias."""

    def __init__(self, model: list[np.ndarray]):
        self.model, self.sums, self.tokens = model, [np.zeros(m.shape) for m in model], 0

    def add(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Texts as (input rows, classes)."""
        line, at = laid([r for r, _ in texts])
        classes = np.concatenate([c for _, c in texts])
        padded = np.zeros((len(line) + 2 * SIDE, HIDDEN), np.float32)
        for first in range(0, len(at), STEP):
            some = at[first:first + STEP]
            back, *rest = gradients(self.model, np.stack([line[some + o] for o in OFFSETS], axis=1), classes[first:first + STEP])
            padded[some + SIDE] = back * len(some)
            for total, g in zip(self.sums[1:], rest):
                total += g * len(some)
        # The line sorted by row serves all positions: only the gradients that meet a row are shifted.
        order = np.argsort(line.astype(np.int16), kind="stable")
        rows = line.take(order)
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        for p, o in enumerate(OFFSETS):
            self.sums[0][p, rows[first]] += np.add.reduceat(padded.take(order - o + SIDE, axis=0), first, axis=0)
        self.tokens += len(at)


class Descent:
    """Steps along mean gradients, scaled by moving averages of the gradients and of their squares (Adam); an input
    row's vector has one scale."""

    def __init__(self, model: list[np.ndarray]):
        self.model, self.steps = model, 0
        self.mean = [np.zeros(m.shape) for m in model]
        self.square = [np.zeros((*m.shape[:-1], 1) if m.ndim == 3 else m.shape) for m in model]

    def step(self, sums: list[np.ndarray], tokens: int) -> None:
        self.steps += 1
        for i, total in enumerate(sums):
            g = total / tokens
            power = (g * g).mean(axis=-1, keepdims=True) if g.ndim == 3 else g * g
            self.mean[i] = KEEP_MEAN * self.mean[i] + (1 - KEEP_MEAN) * g
            self.square[i] = KEEP_SQUARE * self.square[i] + (1 - KEEP_SQUARE) * power
            scale = np.sqrt(self.square[i] / (1 - KEEP_SQUARE ** self.steps)) + 1e-12
            move = self.mean[i] / (1 - KEEP_MEAN ** self.steps) / scale
            self.model[i] = (self.model[i] - RATE * np.clip(move, -3.0, 3.0)).astype(np.float32)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for part in slices(batch, 256):
            yield part, [letters_lower(t or b"") for t in binary(part.column(column))]


def lexicon(texts: DataFrame) -> Lexicon:
    """Counts of all words of ``texts`` (``text``), summed by Spark; only the most frequent words and the number of
    tokens come to the driver. ``unlisted`` holds the other words' hashes and counts above one as a table."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for _, some in _texts(batches, 0):
            for one in some:
                held.update(one.split())
            if len(held) > 200_000:
                yield out()
                held.clear()
        if held:
            yield out()

    counts = cut_lineage(texts.mapInArrow(lean(count), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    # How many words have about how many occurrences, on a grid of a few hundred steps; the list takes whole steps.
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect(), reverse=True)
    least, listed = None, 0
    for r in steps:
        if (listed := listed + r["words"]) > LISTED:
            break
        least = r["step"]
    rows = counts.where(step >= least).collect() if least is not None else []  # LISTED rows at most
    model = Lexicon(sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda w: (-w[1], w[0])), sum(r["n"] for r in steps))
    rest = counts if least is None else counts.where(step < least)
    model.unlisted = rest.where("n > 1").select(F.xxhash64("word").alias("word"), "n")
    return model


def trained(texts: DataFrame, words: Lexicon, rounds: int = 8) -> list[np.ndarray]:
    """Parameters after one step along the summed gradients of each of ``rounds`` parts of the documents.

    Parts are dealt by a hash of all columns of ``texts``, so that an id beside ``text`` spreads equal texts."""
    model = start()
    model[2] = words.log_shares().astype(np.float32)
    descent = Descent(model)
    shapes, size = [m.shape for m in model], sum(m.size for m in model)
    piece = 4_096
    context = texts.sparkSession.sparkContext
    # A task gives sums of a fixed size, however small its part: no more tasks than twice the cores.
    tasks = 2 * context.defaultParallelism
    lexicon_sent = context.broadcast(words)
    for number in range(rounds):
        sent = context.broadcast(descent.model)

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lex, sums, held, tokens = lexicon_sent.value, Gradients(sent.value), [], 0
            for _, some in _texts(batches, 0):
                distinct, which, sizes = words_in_a_row(some)
                rows, classes, _ = lex.numbers(distinct)
                cuts = np.cumsum(sizes)[:-1]
                for one in zip(np.split(rows[which], cuts), np.split(classes[which], cuts)):
                    if len(one[0]):
                        held.append(one)
                        tokens += len(one[0])
                    if tokens >= LOT:
                        sums.add(held)
                        held, tokens = [], 0
            if held:
                sums.add(held)
            if sums.tokens:
                flat = np.concatenate([m.ravel() for m in sums.sums])
                flat = np.append(flat, np.zeros(-size % piece)).astype(np.float32).reshape(-1, piece)
                where = xxhash.xxh32_intdigest(flat.tobytes()) % 64
                for at in sorted({*np.flatnonzero(flat.any(axis=1)).tolist(), len(flat) - 1}):
                    yield pa.RecordBatch.from_pydict({
                        "piece": pa.array([at], pa.int32()), "part": pa.array([where], pa.int32()),
                        "tokens": pa.array([sums.tokens if at == len(flat) - 1 else 0], pa.int64()),
                        "v": pa.array([flat[at].tobytes()], pa.binary())})

        def added(single: bool):
            """Sums by ``piece`` and ``part``, or by ``piece``; ``single``: of single precision."""
            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                sums: dict[tuple[int, int], list] = {}
                for batch in batches:
                    for key, part, n, v in zip(*(batch.column(i).to_pylist() for i in range(4))):
                        slot = sums.setdefault((key, part if single else 0), [0, np.zeros(piece)])
                        slot[0] += n
                        slot[1] += np.frombuffer(v, np.float32 if single else np.float64)
                for (key, part), (n, v) in sums.items():
                    yield pa.RecordBatch.from_pydict({
                        "piece": pa.array([key], pa.int32()), "part": pa.array([part], pa.int32()),
                        "tokens": pa.array([n], pa.int64()), "v": pa.array([v.tobytes()], pa.binary())})
            return add

        kind = "piece int, part int, tokens bigint, v binary"
        some = texts.where(F.pmod(F.xxhash64(*texts.columns), F.lit(rounds)) == number).select("text").coalesce(tasks)
        parts = some.mapInArrow(lean(learn), kind).repartition("piece", "part").mapInArrow(added(True), kind)
        rows = parts.repartition("piece").mapInArrow(added(False), kind).collect()  # one row for each piece of the sums
        sent.destroy()
        tokens = sum(r["tokens"] for r in rows)
        if not tokens:
            continue
        flat = np.zeros((-(-size // piece), piece))
        for r in rows:
            flat[r["piece"]] += np.frombuffer(r["v"])
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])
        descent.step([p.reshape(s) for p, s in zip(np.split(flat.ravel()[:size], cuts[:-1]), shapes)], tokens)
    return descent.model


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 8) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood`` (sum) and ``mean_log_likelihood`` of every document."""
    frame = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    words = lexicon(frame.select("text"))
    sent = frame.sparkSession.sparkContext.broadcast((words, trained(frame, words, rounds)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = sent.value
        for part, some in _texts(batches, 1):
            distinct, which, sizes = words_in_a_row(some)
            rows, classes, shares = (column[which] for column in lex.numbers(distinct))
            # Spark's seed, so that the hashes meet those of ``unlisted``.
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in distinct), np.uint64, len(distinct)).view(np.int64)
            cuts = np.cumsum(sizes)
            around = windows(np.split(rows, cuts[:-1]))
            each = np.empty(len(rows))
            for at in range(0, len(rows), STEP):
                step = slice(at, at + STEP)
                each[step] = log_probabilities(model, around[step], classes[step]) + shares[step]
            before = np.concatenate([[0.0], np.cumsum(each)])
            sums = before[cuts] - before[cuts - sizes]
            places = np.flatnonzero(classes == UNLISTED)
            others = hashes[which[places]]
            bounds = np.searchsorted(places, np.concatenate([[0], cuts]))
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(others, pa.int64())),
            ], ["doc_id", "n_tokens", "log_likelihood", "others"])

    rows = cut_lineage(frame.mapInArrow(
        score, f"doc_id {dict(frame.dtypes)['doc_id']}, n_tokens bigint, log_likelihood double, others array<bigint>"))
    # Numbers of stored rows: ids may repeat or be NULL.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    tallies = rows.select("row", F.explode("others").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    counts = words.unlisted.groupBy("word").agg(F.sum("n").alias("n"))
    more = tallies.join(counts, "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("more"))
    total = F.col("log_likelihood") + F.coalesce("more", F.lit(0.0))
    return rows.drop("others").join(more, "row", "left").select(
        "doc_id", "n_tokens", total.alias("log_likelihood"),
        F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood"))
