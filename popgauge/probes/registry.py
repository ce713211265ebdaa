"""Registry of probe queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popgauge.functions import hashing
from popgauge.session import shared_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def probe(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key!r} registered twice")
        QUERIES[key] = query
        if sql is not None:
            ORACLES[key] = sql
        return query

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of the cluster."""
    return shared_path(spark, name)


def r6(value: Column | str) -> Column:
    return F.round(value, 6)


def _cubic_sql(x: str, prime: int) -> str:
    linear, constant = hashing.CUBIC
    return f"((({x} * {x}) % {prime} * {x} % {prime} + {x} * {linear} + {constant}) % {prime})"


def text_sql(column: str) -> str:
    """SQL of ``hashing.text_number``."""
    return f"CAST('0x' || substr(md5({column}), 1, 15) AS BIGINT)"


def u_sql(*keys: str, stream: int | str = 0) -> str:
    """SQL of ``hashing.hash62``. Every intermediate is named once through a one-element list, as the terms nest."""
    if isinstance(stream, int):
        terms = [str(t) for t in hashing.stream_terms(stream)]
    else:
        p = hashing.PRIMES[0]
        base = f"(((CAST({stream} AS BIGINT) % {p}) + {p}) % {p})"
        terms = [_cubic_sql(f"(({base} * {m} + {c}) % {p})", p) for m, c in hashing.STREAM]
    lanes = []
    for prime, (first, times) in zip(hashing.PRIMES, hashing.FOLD):
        total = str(first)
        for key in keys:
            total = f"(({total}::BIGINT * {times} + ((CAST({key} AS BIGINT) % {prime}) + {prime}) % {prime}) % {prime})"
        lanes.append(total)
    drawn = []
    for prime, (by_a, by_b, plus) in zip(hashing.PRIMES, (terms[:3], terms[3:])):
        mixed = f"(({lanes[0]} * {by_a} % {prime} + {lanes[1]} * {by_b} % {prime} + {plus}) % {prime})"
        drawn.append(f"list_transform([{mixed}], lambda z: {_cubic_sql('z', prime)})[1]")
    return f"({drawn[0]} * {hashing.PRIMES[1]} + {drawn[1]})"


def uniform_sql(*keys: str, stream: int | str = 0) -> str:
    return f"((CAST({u_sql(*keys, stream=stream)} AS DOUBLE) + 0.5::DOUBLE) / {float(hashing.RANGE)!r}::DOUBLE)"


def poisson_sql(u: str) -> str:
    """SQL of ``hashing.poisson_one``."""
    return "(" + " + ".join(f"CAST({u} > {step!r}::DOUBLE AS INTEGER)" for step in hashing.poisson_steps()) + ")"
