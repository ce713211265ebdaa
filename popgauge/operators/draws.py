"""Exact binomial and multinomial counts from uniform draws, vectorised.

A binomial count is read off its distribution function by inversion: the least k with F(k) >= u. The probabilities
around the mean follow from one another by the ratio ``(n - k + 1) / k * p / (1 - p)``; what lies more than nine
standard deviations and forty counts away has less probability than a uniform draw can tell from 0. A count so costs
some twenty standard deviations, about the square root of n, whatever n is. A multinomial count is a chain of binomial
ones: each level's count among those that the levels before it left over.
"""

from __future__ import annotations

import numpy as np

#: Probabilities held at once.
AT_ONCE = 1 << 22


def binomial(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """Counts of ``n`` trials with chance ``p`` at the draws ``u`` in (0, 1): exact inverses of the distribution function."""
    n, u = np.asarray(n, np.int64), np.asarray(u, float)
    if p <= 0:
        return np.zeros_like(n)
    if p >= 1:
        return n.copy()
    if p > 0.5:  # count the failures, whose probabilities fall off from the start
        return n - _inverse(n, 1 - p, 1 - u, np.less_equal)
    return _inverse(n, p, u, np.less)


def _inverse(n: np.ndarray, p: float, u: np.ndarray, before) -> np.ndarray:
    """How many counts have a distribution function ``before`` u, for a chance of at most a half."""
    reach = 9 * np.sqrt(n * p * (1 - p)) + 40
    low = np.maximum(0, np.floor(n * p - reach)).astype(np.int64)
    high = np.minimum(n, np.ceil(n * p + reach)).astype(np.int64)
    out, odds = np.empty_like(n), p / (1 - p)
    width = int((high - low).max(initial=0)) + 1
    for at in range(0, len(n), max(1, AT_ONCE // width)):
        part = slice(at, at + max(1, AT_ONCE // width))
        k = low[part, None] + np.arange(width)
        step = np.maximum(n[part, None] - k + 1, 0) / np.maximum(k, 1) * odds
        step[:, 0] = 1.0
        below = np.cumsum(np.cumprod(step, axis=1), axis=1)
        out[part] = low[part] + before(below, u[part, None] * below[:, -1:]).sum(axis=1)
    return np.minimum(out, high)


def multinomial(n: int, shares: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Counts (levels x draws) that sum to ``n`` for each draw; ``u`` has a row for each level, the last one is not used."""
    left = np.full(u.shape[1], n, np.int64)
    rest, counts = 1.0, []
    for share, at in zip(shares[:-1], u[:-1]):
        count = binomial(left, min(1.0, share / rest) if rest > 0 else 0.0, at)
        counts.append(count)
        left, rest = left - count, rest - share
    return np.array([*counts, left])
