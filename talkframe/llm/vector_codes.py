"""Vector codes of a few bytes: parts of vectors as the numbers of their nearest entries in learned codebooks.

All arithmetic is on whole numbers, so codebooks and codes do not depend on partitions. The
nearest entry is found as a VA-file does it: every coordinate of an entry is a cell of a few
bits, and a cell is the span of the coordinates in it. For each part of a vector a table holds
its least and greatest squared distance to every cell of every coordinate; sums of looked-up
values bound the distance to each entry from below and above, and only entries whose lower bound
does not exceed the least upper one are measured.

A round of learning is one pass over the vectors: a task adds up its parts by entry and sends a
row a coordinate of the codebooks, whatever it has read; Spark adds these up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, checkpointed, hinted, lean, table, tidy, unboxed

#: Units of a component, equal parts of a vector, entries of a codebook (at most 256), rounds of learning, bits of a cell.
SCALE, PARTS, ENTRIES, ROUNDS, BITS = 4096, 8, 16, 6, 3
#: Vectors that are compared at once.
AT_ONCE = 1024
#: The largest double below 2**63.
MOST = float(2**63 - 1024)


def usable(vector: Column, parts: int = PARTS) -> Column:
    """Not null, without null, infinite or undefined components, and of a length that can be cut into equal parts."""
    finite = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))  # noqa: E731 (undefined is greater than infinite)
    return vector.isNotNull() & (F.size(vector) > 0) & (F.pmod(F.size(vector), F.lit(parts)) == 0) & F.forall(vector, finite)


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """Whole numbers of doubles, rounded down; Python's where products of them might not fit in 64 bits."""
    units = np.clip(np.floor(vectors * scale), -MOST, MOST).astype(np.int64)
    room = isqrt(2**62 // max(1, vectors.shape[-1])) // 2
    return units if not units.size or max(int(units.max()), -int(units.min())) < room else units.astype(object)


class Codebooks:
    """``entries`` by part, number and position, and their cells."""

    def __init__(self, entries: np.ndarray, bits: int = BITS) -> None:
        self.entries = entries
        parts, count, width = entries.shape
        rank = np.argsort(np.argsort(entries, axis=1, kind="stable"), axis=1, kind="stable")
        self.cells = rank * min(1 << bits, count) // count
        at = np.sort(entries, axis=1)
        bounds = np.arange(count) * min(1 << bits, count) // count
        starts = np.flatnonzero(np.diff(bounds, prepend=-1))
        self.low = at[:, starts]
        self.high = at[:, np.append(starts[1:], count) - 1]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The number of each part's nearest entry, the least one among equals; its squared distance; and how many were measured."""
        parts, count, width = self.entries.shape
        cut = vectors.reshape(len(vectors), parts, width)
        exact_type = object if object in (vectors.dtype, self.entries.dtype) else np.int64
        codes, errors, measured = np.zeros((len(vectors), parts), np.uint8), np.zeros((len(vectors), parts), exact_type), 0
        place = np.arange(width)
        for p in range(parts):
            for start in range(0, len(vectors), AT_ONCE):
                rows = slice(start, start + AT_ONCE)
                x = cut[rows, p]
                below, above = self.low[p] - x[:, None], x[:, None] - self.high[p]
                least = np.maximum(np.maximum(below, above), 0) ** 2
                most = np.maximum(-below, -above) ** 2
                lower = least[:, self.cells[p], place].sum(axis=2)
                upper = most[:, self.cells[p], place].sum(axis=2)
                who, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
                exact = np.full(lower.shape, 1 << 200 if exact_type is object else np.iinfo(np.int64).max, exact_type)
                exact[who, entry] = ((x[who] - self.entries[p, entry]) ** 2).sum(axis=1)
                codes[rows, p] = exact.argmin(axis=1)
                errors[rows, p] = exact[np.arange(len(x)), codes[rows, p]]
                measured += len(who)
        return codes, errors, measured

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _read(column: pa.Array, width: int, scale: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width), scale)


def _kept(df: DataFrame, parts: int, width: int | None) -> DataFrame:
    return df.where(usable(F.col("vector"), parts) & (F.lit(True) if width is None else F.size("vector") == width))


def learned(df: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``vector``, from the parts of the rows with the least ``vec_id`` and improved ``rounds`` times.

    Null ids come last, rows of equal ids in the order of their vectors. Vectors have the length
    of the first one. None where no vector can be used.
    """
    first = lambda width: [r["vector"] for r in _kept(df, parts, width).orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()]
    start = first(None)
    if len({len(v) for v in start}) > 1:
        start = first(len(start[0]))
    if not start:
        return None
    width = len(start[0])
    units = whole(np.array(start, float), scale)
    books = Codebooks(units.reshape(len(start), parts, width // parts).swapaxes(0, 1))
    for _ in range(rounds):
        books = _improved(df, books, scale, width)
    return books


def _improved(df: DataFrame, books: Codebooks, scale: int, width: int) -> Codebooks:
    shape = books.entries.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(shape[:2], np.int64), np.zeros(shape, object)
        for batch in batches:
            vectors = _read(batch.column(0), width, scale)
            codes = books.nearest(vectors)[0]
            for p in range(shape[0]):
                counts[p] += np.bincount(codes[:, p], minlength=shape[1])
                of_batch = np.zeros(shape[1:], vectors.dtype)
                np.add.at(of_batch, codes[:, p], vectors.reshape(-1, shape[0], shape[2])[:, p])
                sums[p] += of_batch
        used = np.broadcast_to((counts > 0)[:, :, None], shape).ravel()
        at = np.flatnonzero(used)
        total = pa.array([Decimal(int(x)) for x in sums.ravel()[at]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.repeat(counts.ravel(), shape[2])[at], pa.int64()), total], ["at", "n", "total"])

    vectors = lean(_kept(df, shape[0], width).select("vector"))
    sums = vectors.mapInArrow(tidy(add), "at int, n long, total decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    entries = books.entries.copy().ravel()
    for r in sums.collect():  # a row a coordinate of the codebooks at most
        entries[r["at"]] = int(r["total"]) // r["n"]
    return Codebooks(entries.reshape(shape))


def encoded(df: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """The rows whose ``vector`` has the codebooks' length and can be used, with ``code``, two hex digits a part, and ``error``.

    The error is the sum of the squared distances; one beyond 64 bits is the greatest there is.
    All other columns are kept, those of the result's names are replaced; ``vector`` goes.
    """
    parts, _, part = books.entries.shape
    given = lean(boxed(_kept(df, parts, parts * part), vector=F.col("vector")))
    schema = given.select("row").schema.add("code", "string").add("error", "long")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors, _ = books.nearest(_read(batch.column(1), parts * part, scale))
            digits = codes.tobytes().hex()
            text = pa.array([digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)], pa.string())
            error = pa.array([min(int(e), 2**63 - 1) for e in errors.sum(axis=1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), text, error], ["row", "code", "error"])

    return unboxed(given.mapInArrow(tidy(code), schema), df.drop("vector"), code=F.col("code"), error=F.col("error"))


def compressed(df: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every row of ``df`` (vec_id, vector, label) that can be used.

    Rows whose vector is null, empty or holds null, infinite or undefined components take no
    part, nor do those whose length is not that of the first row or can't be cut. Fewer rows than
    entries make smaller codebooks; repeated rows count each; equal distances go to the lower
    entry; components beyond 64 bits count as the greatest there are; null labels are one label,
    null ids stay; an empty table gives an empty result; other columns are ignored. A label's
    rows are added up before they are sent, so that a frequent one costs no more than others.
    """
    rows = df.select("vec_id", "vector", "label")
    books = learned(rows, scale, parts, entries, rounds)
    names = ("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
    if books is None:
        none = rows.where("false").select("vec_id", "label", *(F.lit(None).cast(t).alias(n) for n, t in zip(names[2:], ("string", "long", "long", "string"), strict=True)))
        return none.select(*names)
    coded = checkpointed(encoded(rows, books, scale))
    sums = hinted(checkpointed(coded.groupBy(F.col("label").alias("of")).agg(F.coalesce(F.try_sum("error"), F.lit(2**63 - 1)).alias("label_error"))))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.withColumn("codebooks_sha256", F.lit(books.sha256())).select(*names)


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """All vectors as codes of eight entries."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    return compressed(vectors).drop("label")


def _sql() -> str:
    """The same in SQL: every part meets every entry, six times and once more."""
    nearest = """SELECT vec_id, label, p, x, min((list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) * {n} + e)::BIGINT) AS best
  FROM parts JOIN b{i} USING (p) GROUP BY vec_id, label, p, x"""
    better = """b{j} AS MATERIALIZED (
  SELECT p, e, coalesce(m, c) AS c FROM b{i} LEFT JOIN (
    SELECT p, e, list(((s - ((s % k + k) % k)) // k)::BIGINT ORDER BY i) AS m FROM (
      SELECT p, best % {n} AS e, i, sum(x[i]) AS s, count(*) AS k FROM a{i}, range(1, 9) r(i) GROUP BY ALL) GROUP BY p, e) USING (p, e))"""
    rounds = ",\n".join(f"a{i} AS MATERIALIZED (\n  {nearest.format(n=ENTRIES, i=i)}),\n{better.format(n=ENTRIES, i=i, j=i + 1)}" for i in range(ROUNDS))
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[8 * p + 1:8 * p + 8] AS x FROM kept, range({PARTS}) r(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
{rounds},
last AS ({nearest.format(n=ENTRIES, i=ROUNDS)}),
coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY p) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM last GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256
FROM coded
"""


OP13_SQL = _sql()
