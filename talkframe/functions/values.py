"""Small value functions: decay, identifiers, and maps from one value to another."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def decay(base: Column, step: Column, by: float = 0.92) -> Column:
    """``base`` in step 1, and ``by`` times as much in each step after it."""
    return base * F.pow(F.lit(by), step - 1)


def new_id() -> Column:
    """A random UUID for each row."""
    return F.uuid()


def stable_id(*of: Column) -> Column:
    """A UUID-shaped digest of some values: the same whenever it is worked out again."""
    digest = F.md5(F.to_json(F.array(*(c.cast("string") for c in of))))
    part = lambda start, n: F.substring(digest, start, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("3"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12))


def mapped(value: Column, to: Mapping[str, str], default: str | None = None) -> Column:
    """What a value maps to, or the default; a null value maps to the default as well."""
    if not to:
        return F.lit(default)
    found = F.create_map(*(F.lit(x) for pair in to.items() for x in pair))[value]
    return found if default is None else F.coalesce(found, F.lit(default))
