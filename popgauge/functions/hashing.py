"""Seeded randomness as plain arithmetic.

``rand()`` changes when a lost task is recomputed on different partitions. Here a draw depends on the row's own keys
only: keys are folded into two lanes modulo two primes (about 62 bits together), a stream mixes both lanes with its
own multipliers, and a cubic polynomial scatters the result. Draws are repeatable, free of state, evaluated inside
whole-stage codegen, and expressible in any SQL engine. Two rows share a draw only if both lanes agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two lanes' primes, 2**31 - 1 and the prime before it.
PRIMES = (2_147_483_647, 2_147_483_629)
RANGE = PRIMES[0] * PRIMES[1]
LANE = 1 << 31
#: First value and multiplier of each lane's fold, multipliers and addends of the streams, terms of the cubic.
FOLD = ((48_271, 1_103_515_245), (69_621, 1_277_850_838))
STREAM = ((40_692, 1_566_083_941), (742_938_285, 950_706_376), (1_226_874_159, 62_089_911), (1_343_714_438, 630_360_016),
          (397_204_094, 2_027_812_808), (784_588_716, 1_812_433_253))
CUBIC = (40_692, 1_566_083_941)


def text_number(text: Column | str) -> Column:
    """Number of a text: 60 bits of its MD5."""
    column = F.col(text) if isinstance(text, str) else text
    return F.conv(F.substring(F.md5(column.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")


def _number(key: Column | str) -> Column:
    """A key as a number: whole numbers as they are, other texts by their MD5; NULL is 0."""
    column = F.col(key) if isinstance(key, str) else key
    return F.coalesce(column.try_cast("bigint"), text_number(column), F.lit(0).cast("bigint"))


def key_sum(*keys: Column | str) -> Column:
    """The keys' part of a draw, both lanes in one number: compute it once where one row needs many streams."""
    numbers = [_number(k) for k in keys]
    lanes = []
    for prime, (first, times) in zip(PRIMES, FOLD):
        total = F.lit(first).cast("bigint")
        for number in numbers:
            total = (total * F.lit(times).cast("bigint") + F.pmod(number, F.lit(prime).cast("bigint"))) % F.lit(prime)
        lanes.append(total)
    return lanes[0] * F.lit(LANE).cast("bigint") + lanes[1]


def cubic(x, prime):
    """Scatters ``x`` in [0, prime); works on numbers and on columns. Two products of numbers below 2**31 - 1 fit 63 bits."""
    linear, constant = CUBIC
    if isinstance(x, Column):
        linear, constant, prime = (F.lit(v).cast("bigint") for v in (linear, constant, prime))
    return ((x * x) % prime * x + x * linear + constant) % prime


def stream_terms(stream: int | Column) -> list:
    """Six multipliers and addends of a stream."""
    prime = PRIMES[0]
    if isinstance(stream, Column):
        base = F.pmod(stream.cast("bigint"), F.lit(prime).cast("bigint"))
        return [cubic((base * F.lit(m).cast("bigint") + F.lit(c)) % F.lit(prime), prime) for m, c in STREAM]
    return [cubic((stream % prime * m + c) % prime, prime) for m, c in STREAM]


def stream_hash(keys: Column, stream: int | Column = 0) -> Column:
    """Integer in [0, RANGE) from a ``key_sum``; another ``stream`` gives an independent draw."""
    terms = [t if isinstance(t, Column) else F.lit(t).cast("bigint") for t in stream_terms(stream)]
    a, b = F.shiftright(keys, 31), keys.bitwiseAND(F.lit(LANE - 1))
    drawn = []
    for prime, (by_a, by_b, plus) in zip(PRIMES, (terms[:3], terms[3:])):
        mixed = (a * by_a + b * by_b + plus) % F.lit(prime)
        drawn.append(cubic(mixed, prime))
    return drawn[0] * F.lit(PRIMES[1]).cast("bigint") + drawn[1]


def stream_uniform(keys: Column, stream: int | Column = 0) -> Column:
    """Uniform draw in (0, 1) from a ``key_sum``."""
    return (stream_hash(keys, stream).cast("double") + F.lit(0.5)) / F.lit(float(RANGE))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` uses it, also per array element."""
    return F.transform(F.array(value), then)[0]


def uniform_for_filter(keys: Column, stream: int) -> Column:
    """``stream_uniform`` for use in a filter. Filters are pushed below the projection that names a draw and then compute
    each of its nested terms anew wherever it is used; here every term is bound to a variable first."""
    terms = [F.lit(t).cast("bigint") for t in stream_terms(stream)]

    def scattered(prime: int) -> Callable[[Column], Column]:
        return lambda x: cubic(x, prime)

    def draw(k: Column) -> Column:
        a, b, drawn = F.shiftright(k, 31), k.bitwiseAND(F.lit(LANE - 1)), []
        for prime, (by_a, by_b, plus) in zip(PRIMES, (terms[:3], terms[3:])):
            mixed = (a * by_a + b * by_b + plus) % F.lit(prime)
            drawn.append(once(mixed, scattered(prime)))
        return (drawn[0] * F.lit(PRIMES[1]).cast("bigint") + drawn[1]).cast("double")

    return (once(keys, draw) + F.lit(0.5)) / F.lit(float(RANGE))


def uniform_array(keys: np.ndarray, streams: Sequence[int]) -> np.ndarray:
    """``stream_uniform`` of every key (rows) and stream (columns), in numpy; no product leaves 63 bits."""
    out = np.empty((len(keys), len(streams)))
    for at, u in enumerate(_uniforms(keys, streams)):
        out[:, at] = u
    return out


def _uniforms(keys: np.ndarray, streams: Sequence[int]) -> Iterator[np.ndarray]:
    a, b = keys.astype(np.int64) >> 31, keys.astype(np.int64) & (LANE - 1)
    for stream in streams:
        terms, drawn = stream_terms(int(stream)), []
        for prime, (by_a, by_b, plus) in zip(PRIMES, (terms[:3], terms[3:])):
            drawn.append(cubic((a * by_a + b * by_b + plus) % prime, prime))
        yield ((drawn[0] * PRIMES[1] + drawn[1]).astype(float) + 0.5) / float(RANGE)


def hash62(*keys: Column | str, stream: int | Column = 0) -> Column:
    """Integer in [0, RANGE) drawn from the keys."""
    return stream_hash(key_sum(*keys), stream)


def uniform(*keys: Column | str, stream: int | Column = 0) -> Column:
    """Uniform draw in the open interval (0, 1) from the keys."""
    return stream_uniform(key_sum(*keys), stream)


def normal(first: Column, second: Column) -> Column:
    """Standard normal draw from two uniform ones."""
    return F.sqrt(F.lit(-2.0) * F.ln(first)) * F.cos(F.lit(2.0) * F.pi() * second)


def poisson_steps() -> list[float]:
    """Distribution function of Poisson(1) up to the count from which it is 1 in double precision."""
    total, term, steps = 0.0, 2.718281828459045 ** -1, []
    while total + term > total and total < 1.0:
        total += term
        term /= len(steps) + 1
        steps.append(total)
    return steps


def poisson_one(u: Column) -> Column:
    """Poisson(1) count by inverting its distribution function at ``u``."""
    chain = F
    steps = poisson_steps()
    for k, step in enumerate(steps):
        chain = chain.when(u <= F.lit(step), F.lit(k))
    return chain.otherwise(F.lit(len(steps)))


def poisson_counts(keys: Column, streams: Sequence[int]) -> Column:
    """``poisson_one`` of ``stream_uniform`` for each of many streams, as one array a row.

    A dozen such draws in one generated method are more than the JVM compiles by default (8,000 bytes of bytecode): every
    row then went through its interpreter. Here the draws of a batch of rows are made in numpy."""
    streams, steps = list(streams), poisson_steps()

    def draw(k: pa.Array) -> pa.Array:
        counts = np.zeros((len(k), len(streams)), np.int8)
        for at, u in enumerate(_uniforms(k.to_numpy(zero_copy_only=False), streams)):
            for step in steps:
                over = u > step
                if not over.any():
                    break
                counts[:, at] += over
        ends = np.arange(0, counts.size + 1, len(streams), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.ravel()))

    return F.arrow_udf(draw, "array<tinyint>")(keys)
