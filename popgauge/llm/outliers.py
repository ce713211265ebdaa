"""Quality rules with robust multivariate outliers, in native expressions only.

Counts of the whole text give the base rules and a vector of transformed statistics. For every cell (language and
source; a cell of too few rows joins the rest of its language, then of the corpus) the minimum-covariance-determinant
estimate is approached by concentration steps from two deterministic starts, the classical estimate and a
median / MAD one: the share ``SUBSET`` of rows nearest to the estimate gives the next one, and the end with the
smaller determinant counts. A document is rejected if its squared Mahalanobis distance exceeds ``CUTOFF``.

Nearest rows are chosen on a fine logarithmic grid of distances whose counts Spark sums, so no cell is sorted or
collected, however large. Estimates (a few numbers per cell) are stored in the shared folder after each step and
joined by cell; Spark broadcasts them where their files are small enough.

Defined results: NULL and blank texts have no words and fail the base rules; NULL languages and sources are values of
their own; equal rows are judged alike; a corpus smaller than ``LEAST_ROWS`` is one pooled cell (the floors keep its
covariance regular, down to one row); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popgauge.llm.common import BLANKS, native_words, stored

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Share of a cell's rows that a concentration step keeps; rows that a cell needs; steps from each start.
SUBSET, LEAST_ROWS, STEPS = 0.75, 200, 4
#: Standard deviations added to each statistic's own, so that one that hardly varies cannot reject by itself.
FLOORS = (0.10, 0.06, 0.12, 0.12, 0.08)
SIZE = len(FLOORS)
#: Median of a chi-square of five degrees of freedom, and its quantile at 0.9999.
CHI_MEDIAN, CUTOFF = 4.351, 25.745
GRID = 50


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, the first occurrence included."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(3)]))

    def counted(ranked: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            one, two = F.get(ranked, a), F.get(ranked, b)
            equal = [F.get(words, one["i"] + k) == F.get(words, two["i"] + k) for k in range(3)]
            return F.coalesce(reduce(lambda p, q: p & q, equal, one["h"] == two["h"]), F.lit(False))

        places = F.sort_array(F.transform(F.filter(ranked, lambda x, k: same(k - 1, k) | same(k, k + 1)), lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(places, zero, lambda acc, p: F.struct(
            (p + 3).alias("end"), (acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n")), lambda acc: acc["n"])

    def some(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(h) > F.size(F.array_distinct(h)), F.transform(F.array(ranked), counted)[0]).otherwise(0)

    return F.when(F.size(words) >= 3, F.transform(F.array(hashes), some)[0]).otherwise(0)


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``doc_id, fine, wide`` (keys of the cell and of its language) and the counts of every whole text."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    first = docs.select(
        F.col(doc_id).alias("doc_id"), named(lang).alias("wide"), F.concat_ws("\x1f", named(lang), named(source)).alias("fine"),
        whole.alias("text"), native_words(whole).alias("words"),
        F.filter(F.split(whole, "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0).alias("lines"),
    )
    without = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    return first.select(
        "doc_id", "fine", "wide", F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("bigint").alias("word_chars"),
        without(SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _repeated(F.col("words")).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"), without(UPPER).cast("bigint").alias("n_upper"),
    )


def vector() -> list[Column]:
    """Transformed statistics; the added constants draw short texts towards the ordinary."""
    c = F.col
    return [
        F.log((c("word_chars") + 50.0) / (c("n_words") + 10.0)), F.sqrt(c("n_symbols") / (c("word_chars") + 100.0)),
        F.sqrt(c("n_dup_lines") / (c("n_lines") + 5.0)), F.sqrt(c("n_repeat_words") / (c("n_words") + 30.0)),
        F.sqrt(c("n_upper") / (c("word_chars") + 100.0)),
    ]


X = [f"x{i}" for i in range(SIZE)]


def _cells(rows: DataFrame) -> DataFrame:
    """``fine, cell``: the cell that each language and source is judged in."""
    fine = rows.groupBy("fine", "wide").agg(F.count(F.lit(1)).alias("n"))
    large = fine.where(F.col("n") >= LEAST_ROWS).select("fine", F.col("fine").alias("cell"))
    small = fine.where(F.col("n") < LEAST_ROWS)
    wide = small.groupBy("wide").agg(F.sum("n").alias("of_wide"))
    pooled = small.join(wide, "wide").select(
        "fine", F.when(F.col("of_wide") >= LEAST_ROWS, F.concat(F.lit("rest\x1f"), "wide")).otherwise(F.lit("rest")).alias("cell"))
    return large.unionByName(pooled)


def _estimate(rows: DataFrame) -> DataFrame:
    """Mean, inverse Cholesky factor of the regularised covariance and log determinant of each cell."""
    sums = [F.avg(x).alias(f"m{i}") for i, x in enumerate(X)] + [
        F.covar_pop(X[i], X[j]).alias(f"c{i}{j}") for i in range(SIZE) for j in range(i + 1)]
    return _factored(rows.groupBy("cell").agg(*sums))


def _factored(moments: DataFrame) -> DataFrame:
    out = moments
    for j in range(SIZE):
        for i in range(j, SIZE):
            rest = F.col(f"c{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    for j in range(SIZE):
        for i in range(j, SIZE):
            if i == j:
                value = 1.0 / F.col(f"l{i}{i}")
            else:
                value = -reduce(add, [F.col(f"l{i}{k}") * F.col(f"v{k}{j}") for k in range(j, i)]) / F.col(f"l{i}{i}")
            out = out.withColumn(f"v{i}{j}", value)
    factor = [f"v{i}{j}" for i in range(SIZE) for j in range(i + 1)]
    volume = 2.0 * reduce(add, [F.log(f"l{i}{i}") for i in range(SIZE)])
    return out.select("cell", *[f"m{i}" for i in range(SIZE)], *factor, volume.alias("volume"))


def _distance() -> Column:
    """Squared Mahalanobis distance from the joined estimate."""
    terms = []
    for i in range(SIZE):
        y = reduce(add, [F.col(f"v{i}{j}") * (F.col(X[j]) - F.col(f"m{j}")) for j in range(i + 1)])
        terms.append(y * y)
    return reduce(add, terms)


def _bin() -> Column:
    return F.floor(F.log(_distance() + 1e-9) * GRID).cast("int")


def _reached(rows: DataFrame, estimate: DataFrame, share: float, name: str) -> DataFrame:
    """The estimate with the grid cell up to which this share of its rows lies."""
    held = rows.join(estimate, "cell").groupBy("cell", _bin().alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto, whole = Window.partitionBy("cell").orderBy("bin"), Window.partitionBy("cell")
    found = held.select("cell", "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("all")).where(
        F.col("upto") >= share * F.col("all")).groupBy("cell").agg(F.min("bin").alias(name))
    return estimate.join(found, "cell")


def _medians(rows: DataFrame, values: list[Column]) -> DataFrame:
    """Median of each value by cell, to a hundredth, from counts on a grid."""
    each = rows.select("cell", F.posexplode(F.array(*[F.round(v * 100).cast("int") for v in values])).alias("i", "g"))
    held = each.groupBy("cell", "i", "g").agg(F.count(F.lit(1)).alias("n"))
    upto, whole = Window.partitionBy("cell", "i").orderBy("g"), Window.partitionBy("cell", "i")
    middle = held.select("cell", "i", "g", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("all")).where("2 * upto >= all")
    return middle.groupBy("cell").agg(*[F.min(F.when(F.col("i") == i, F.col("g"))).alias(f"q{i}") for i in range(len(values))])


def _robust_start(rows: DataFrame) -> DataFrame:
    """Medians and diagonal MAD scales as an estimate."""
    centre = stored(_medians(rows, [F.col(x) for x in X]).select("cell", *[(F.col(f"q{i}") / 100.0).alias(f"m{i}") for i in range(SIZE)]), "mcd-centre")
    spread = _medians(rows.join(centre, "cell"), [F.abs(F.col(x) - F.col(f"m{i}")) for i, x in enumerate(X)])
    zeros = [F.lit(0.0).alias(f"c{i}{j}") for i in range(SIZE) for j in range(i)]
    squares = [F.pow(F.col(f"q{i}") * 0.014826, 2).alias(f"c{i}{i}") for i in range(SIZE)]
    return _factored(centre.join(spread, "cell").select("cell", *[f"m{i}" for i in range(SIZE)], *zeros, *squares))


def minimum_determinant(rows: DataFrame) -> DataFrame:
    """Estimate of every cell of ``rows`` (``cell, x0..``), with ``middle``, the grid cell of the median distance."""
    ends = []
    for start in (_estimate(rows), _robust_start(rows)):
        now = stored(start, "mcd-start")
        for _ in range(STEPS):
            bound = stored(_reached(rows, now, SUBSET, "bound"), "mcd-bound")
            now = stored(_estimate(rows.join(bound, "cell").where(_bin() <= F.col("bound"))), "mcd-estimate")
        ends.append(now)
    columns = [c for c in ends[0].columns if c not in ("cell", "volume")]
    least = ends[0].unionByName(ends[1]).groupBy("cell").agg(F.min(F.struct("volume", *columns)).alias("e")).select("cell", "e.*")
    return stored(_reached(rows, stored(least, "mcd-least"), 0.5, "middle"), "mcd-final")


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts, ``base_failed``, ``distance`` (scaled; NULL where the base rules reject all of a cell) and ``kept`` of every document."""
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rows = stored(counts(docs, doc_id, text, lang, source).select("*", failed.alias("base_failed"), *[v.alias(x) for v, x in zip(vector(), X)]), "mcd-counts")
    sound = rows.where("NOT base_failed")
    cells = stored(_cells(sound), "mcd-cells")
    in_cells = sound.join(cells, "fine").select("cell", *X)
    estimate = minimum_determinant(stored(in_cells, "mcd-vectors"))
    scale = F.greatest(F.exp((F.col("middle") + 1) / GRID) / CHI_MEDIAN, F.lit(1.0))
    placed = cells.join(estimate, "cell")
    out = rows.join(placed, "fine", "left").withColumn("distance", _distance() / scale)
    return out.select(
        *[c for c in rows.columns if c not in X], "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))).alias("kept"))
