"""Hard negatives against brute force over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from popgauge.llm import negatives

SCHEMA = "vec_id bigint, label int, vector array<bigint>, row string, block int, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, label, v, "r", 1, 0.5) for i, label, v in rows], SCHEMA)


def brute(rows, step, positives=5, negatives_=5, low=80, high=100):
    rows = sorted({(i, label, tuple(v)) for i, label, v in rows if i is not None and label is not None and v is not None and None not in v})
    if not rows:
        return []
    sizes = [len(v) for *_, v in rows]
    size = max(sizes, key=lambda s: (sizes.count(s), s))
    rows, out = [r for r in rows if len(r[2]) == size], []
    for a in rows:
        if a[0] % step:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b) for b in rows if b != a), key=lambda s: s[:2])
        for p, i, _ in [s for s in scored if s[2][1] == a[1]][:positives]:
            hard = [s for s in scored if s[2][1] != a[1] and low * -p <= 100 * -s[0] <= high * -p][:negatives_]
            out += [(a[0], i, k, s[1], -p, -s[0]) for k, s in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, step, **options):
    return sorted(map(tuple, negatives.mine(table(spark, rows), F.col("vec_id") % step == 0, **options).collect()))


def clustered(n, size, labels, seed, spread):
    r = np.random.default_rng(seed)
    centres = r.integers(-80, 80, (12, size))
    v = centres[r.integers(0, 12, n)] + r.integers(-spread, spread + 1, (n, size))
    return [(i, int(r.integers(labels)), v[i].tolist()) for i in range(n)]


@pytest.mark.parametrize(("n", "size", "spread"), [(700, 8, 5), (400, 7, 90), (900, 2, 3)])
def test_matches_brute_force(spark, n, size, spread):
    rows = clustered(n, size, 4, n, spread)
    assert mined(spark, rows, 10, block=64, first=100, anchors_per_group=30, sample=200) == brute(rows, 10)


def test_awkward_rows(spark):
    r = random.Random(2)
    same = [3, -1, 4, 1]
    rows = [(i, i % 2, same) for i in range(300)] + [(300 + i, i % 3, [r.randrange(-9, 9) for _ in range(4)]) for i in range(80)]
    rows += [(None, 1, same), (400, None, same), (410, 1, None), (420, 1, [1, None, 2, 3]), (430, 1, [1, 2, 3]), (440, 7, same), (450, 1, [0, 0, 0, 0])]
    rows += [(10, 0, same), (460, 1, [-50, 0, 0, 0]), (470, 2, [50, 1, 1, 1]), (480, 1, [50, 0, 0, 0])]
    assert mined(spark, rows, 10, block=32, first=40, anchors_per_group=7) == brute(rows, 10)


def test_rows_of_one_id_are_rows_of_their_own(spark):
    rows = [(100, 1, [5, 5]), (100, 1, [5, 6]), (100, 2, [5, 5]), (3, 1, [5, 5]), (4, 2, [4, 5])]
    got = mined(spark, rows, 100)
    assert {g[:2] for g in got} <= {(100, 100), (100, 3)} and got == brute(rows, 100)


def test_few_or_no_rows(spark):
    assert mined(spark, [], 1) == []
    assert mined(spark, [(0, 1, [1, 2])], 1) == []
    assert mined(spark, [(0, 1, [2]), (1, 1, [3]), (2, 2, [3])], 1) == brute([(0, 1, [2]), (1, 1, [3]), (2, 2, [3])], 1)
    assert mined(spark, [(0, 1, []), (1, 1, []), (2, 2, [])], 1) == brute([(0, 1, []), (1, 1, []), (2, 2, [])], 1)


def test_components_too_large_are_an_error(spark):
    with pytest.raises(ValueError, match="not exact"):
        mined(spark, [(0, 1, [1 << 30, 0]), (1, 1, [1, 1])], 1)


def test_cells_are_left_out_when_certified():
    """On clustered rows the walk ends early, and what it leaves out is below the bound."""
    rows = np.array([v for *_, v in clustered(2_000, 8, 4, 5, 3)], float)
    halves = np.split(rows, 2, 1)
    books = [negatives.codebook(h, 12) for h in halves]
    (one, far_one), (two, far_two) = (negatives.nearest(h, b) for h, b in zip(halves, books))
    cells = {}
    for i, j, a, b in zip(one, two, far_one, far_two):
        n, x, y = cells.get((i, j), (0, 0.0, 0.0))
        cells[i, j] = (n + 1, max(x, a), max(y, b))
    made = negatives.MultiIndex(books, cells, 50)
    first, second = made.bounds(rows[:1])
    order = [b for b, *_ in negatives.walk(first[0], second[0])]
    assert order == sorted(order, reverse=True) and len(order) == len(books[0]) * len(books[1])
    scores = rows @ rows[0]
    least = np.sort(scores)[-20]
    inside = {b for cell in made.blocks for b in made.blocks[cell]}
    looked = set(made.visits(first[0], second[0], 100, None)) | set(made.visits(first[0], second[0], 100, least))
    assert len(looked) < len(inside) / 2
    for cell, bound in {(i, j): b for b, i, j in negatives.walk(first[0], second[0])}.items():
        members = (one == cell[0]) & (two == cell[1])
        assert not members.any() or scores[members].max() <= bound
        if members.any() and scores[members].max() >= least:
            assert looked >= set(made.blocks[cell])
