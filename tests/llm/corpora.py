"""Small corpora with the awkward cases, and brute-force versions of what the operators find."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, lanes int, size string, row int, x int, tie string"


def frame(spark, rows):
    """A documents table of ``(doc_id, text)`` with extra columns whose names operators use inside."""
    return spark.createDataFrame(
        [(i, t, "en" if n % 3 else None, f"s{n % 2}" if n % 5 else None, 1, "n", 2, "s", 3, 4, "t") for n, (i, t) in enumerate(rows)], SCHEMA)


def sentence(random_, n, vocabulary=400):
    return " ".join(f"w{random_.randrange(vocabulary)}" for _ in range(n))


def awkward(seed=1):
    """Nulls, blanks, ties, copies, near copies, repeated rows, shared passages and a very long text."""
    r = random.Random(seed)
    passage, base = sentence(r, 60), sentence(r, 120)
    near = base.split()
    near[70] = "changed"
    rows = [
        (None, sentence(r, 50)), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, base), (7, base), (7, base),
        (8, " ".join(near)), (9, sentence(r, 30) + "\n" + passage + "\n" + sentence(r, 30)), (10, passage), (11, sentence(r, 20) + " " + passage),
        (12, sentence(r, 5_000)), (13, "a a a a " * 30), (14, "naïve café x y \U0001F600 " * 12), (15, "line one\nline one\n\nLINE ONE\n"),
    ]
    return rows + [(20 + i, sentence(r, r.randrange(1, 150))) for i in range(40)]


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def classes(n, linked):
    """Least index reachable, by brute force over all pairs."""
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
