"""Randomness from hashes: the same row draws the same number, however rows are dealt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A number from 0 (inclusive) to 1 for the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def below(n: Column | int, seed: int, *keys: Column) -> Column:
    """A whole number from 0 to ``n - 1``."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(F.xxhash64(F.lit(seed), *keys), n.cast("long"))


def order(seed: int, *keys: Column) -> Column:
    """A shuffle is a sort by this."""
    return F.xxhash64(F.lit(seed), *keys)


def choose(values: Sequence, weights: Sequence[float] | None, seed: int, *keys: Column) -> Column:
    """One of the values, in proportion to its weight."""
    weights = weights or [1.0] * len(values)
    total, edge, out = sum(weights), 0.0, None
    u = uniform(seed, *keys)
    for value, weight in zip(values[:-1], weights):
        edge += weight / total
        out = F.when(u < edge, F.lit(value)) if out is None else out.when(u < edge, F.lit(value))
    return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))
