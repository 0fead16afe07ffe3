"""Sharding by histogram sort: splitters from exact byte counts, then one exchange.

Rows are ordered by (hash of the text, hash of the document id). Equal texts lie side by side,
so a group of equal texts is cut only where a boundary has to pass through it. The splitters
are found from counts alone: each round sums the exact bytes in up to ``bins`` equal ranges of
every interval that still holds a wanted boundary, over all partitions with partial sums, and
brings back at most ``bins`` rows an open interval. Rounds go on inside the one range that
holds the boundary until that range is lighter than the tolerance, or until one key is left.

Everything here is a DataFrame expression: no Python code runs on an executor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, bytes_of, checkpointed, table, text_or_empty, unboxed

LOWEST = -(2**63)
#: Rows that are numbered in one task, about, and the most ranges of them, as a power of two.
ROWS_A_RANGE, MOST_RANGES = 1_000_000, 17


@dataclass(frozen=True)
class Interval:
    """Keys that may hold a boundary: ``first`` is fixed once only the second hash is open."""

    low: int
    high: int
    first: int | None
    below: int  # bytes of all keys under the interval
    wanted: tuple[int, ...]  # the boundaries, in bytes, that lie in it


def _shift(low: int, high: int, bins: int) -> int:
    """The least power of two by which the range falls into at most ``bins`` parts."""
    return max(0, (high - low).bit_length() - (bins.bit_length() - 1))


def _histogram(keys: DataFrame, open_: list[Interval], bins: int) -> dict[int, list]:
    """For each open interval its filled ranges, in key order."""
    which, part = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, x in enumerate(open_):
        column = "_h" if x.first is None else "_g"
        inside = F.col(column).between(x.low, x.high)
        if x.first is not None:
            inside &= F.col("_h") == F.lit(x.first)
        # Halves first: the difference of two longs may be wider than a long.
        shift = _shift(x.low, x.high, bins)
        at = (
            F.shiftright(F.col(column), shift) - F.lit(x.low >> shift)
            if shift
            else F.col(column) - F.lit(x.low)
        )
        which = F.when(inside, F.lit(i)).otherwise(which)
        part = F.when(inside, at.cast("long")).otherwise(part)
    rows = (
        keys.select(which.alias("_i"), part.alias("_p"), "_h", "_g", "_size")
        .where(F.col("_i").isNotNull())
        .groupBy("_i", "_p")
        .agg(
            F.sum("_size").alias("bytes"),
            *(f(c).alias(n) for n, f, c in (("h0", F.min, "_h"), ("h1", F.max, "_h"), ("g0", F.min, "_g"), ("g1", F.max, "_g"))),
        )
        .collect()
    )
    out: dict[int, list] = {i: [] for i in range(len(open_))}
    for r in sorted(rows, key=lambda r: (r["_i"], r["_p"])):
        out[r["_i"]].append(r)
    return out


def splitters(keys: DataFrame, n_shards: int, tolerance: float = 0.002, bins: int = 4096) -> list[tuple[int, int]]:
    """The first key (h, g) of shards 1 to ``n_shards - 1``, each within ``tolerance`` of a shard.

    ``keys`` has _h, _g and _size. Only rows with an equal (h, g), which are repeated rows, are
    never parted. An empty input gives no splitters.
    """
    total = keys.agg(F.sum("_size")).first()[0]
    if not total or n_shards < 2:
        return []
    slack = max(1, int(total / n_shards * tolerance))
    wanted = tuple(total * k // n_shards for k in range(1, n_shards))
    open_ = [Interval(LOWEST, -LOWEST - 1, None, 0, wanted)]
    found: list[tuple[int, tuple[int, int]]] = []
    while open_:
        next_: list[Interval] = []
        for i, ranges in _histogram(keys, open_, bins).items():
            x = open_[i]
            below, least = x.below, "h0" if x.first is None else "g0"
            edges = [r[least] for r in ranges]
            after = x.high + 1
            for k, r in enumerate(ranges):
                inside = tuple(w for w in x.wanted if below < w <= below + r["bytes"] or k == 0 and w <= below)
                if inside:
                    key = lambda v: (v, LOWEST) if x.first is None else (x.first, v)
                    up = edges[k + 1] if k + 1 < len(edges) else after
                    one_h, one_key = r["h0"] == r["h1"], r["h0"] == r["h1"] and r["g0"] == r["g1"]
                    if r["bytes"] <= slack or one_key:
                        for w in inside:
                            near = w - below <= below + r["bytes"] - w
                            found.append((w, key(edges[k]) if near else key(min(up, -LOWEST - 1))))
                    elif one_h:
                        next_.append(Interval(r["g0"], r["g1"], r["h0"], below, inside))
                    else:
                        next_.append(Interval(r["h0"], r["h1"], None, below, inside))
                below += r["bytes"]
        open_ = next_
    cuts = [k for _, k in sorted(found)]
    return [max(cuts[: i + 1]) for i in range(len(cuts))]


def _shard_of(cuts: list[tuple[int, int]]) -> Column:
    shard = F.lit(0)
    for h, g in cuts:
        shard = shard + ((F.col("_h") > F.lit(h)) | ((F.col("_h") == F.lit(h)) & (F.col("_g") >= F.lit(g)))).cast("int")
    return shard


def histogram_sort(
    docs: DataFrame, n_shards: int = 16, tolerance: float = 0.002, bins: int = 4096, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """All columns of ``docs`` with shard (int, 0 up) and slot (long, gapless from 0 in its shard).

    A row weighs its text's UTF-8 bytes plus one; the shards' weights differ by no more than
    the tolerance, twice the heaviest row and the weight of rows repeated as a whole. Null and
    empty texts weigh one and count as equal; a null id hashes like any other value; repeated
    rows get slots of their own; an empty table gives an empty result. Input columns named
    shard or slot are replaced, all others kept, whatever their names.

    Slots need no task that holds a shard. Equal ranges of the first hash, of a million rows or
    so, the crowded ones cut further by the second hash, are numbered alone after the one
    exchange; their first slots come from a table with at most about ``2 * ranges + n_shards``
    rows, which is broadcast: there are ``bins`` ranges at least and 2**17 at most.
    """
    keyed = boxed(docs, _h=F.xxhash64(text_or_empty(text)), _g=F.xxhash64(F.col(key)), _size=bytes_of(text) + 1)
    keys = checkpointed(keyed.select("_h", "_g", "_size"))
    shard = _shard_of(splitters(keys, n_shards, tolerance, bins))
    n_rows = keys.count()
    ranges = max(bins, 1 << min(MOST_RANGES, (n_rows // ROWS_A_RANGE).bit_length()))
    low_bits = 64 - (ranges.bit_length() - 1)
    room = max(1, 2 * n_rows // ranges)
    crowded = (
        keys.groupBy(F.shiftright("_h", low_bits).alias("_bin"))
        .count()
        .where(F.col("count") > room)
        .select("_bin", F.least(F.lit(20), F.ceil(F.log2(F.col("count") / F.lit(room)))).cast("int").alias("_bits"))
    )

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("_bin", F.shiftright("_h", low_bits)).join(F.broadcast(crowded), "_bin", "left")
        part = F.when(F.col("_bits").isNull(), F.lit(0).cast("long")).otherwise(
            F.expr("shiftright(shiftright(_g, 1) + 4611686018427387904L, 63 - _bits)")
        )
        # Within a range the hot text's rows are parted by the second hash, so the second hash leads there.
        return df.withColumns({"_shard": shard, "_part": part})

    firsts = (
        placed(keys)
        .groupBy("_shard", "_bin", "_part")
        .agg(F.count("*").alias("_n"))
        .select(
            "_shard", "_bin", "_part",
            (F.sum("_n").over(Window.partitionBy("_shard").orderBy("_bin", "_part")) - F.col("_n")).alias("_first"),
        )
    )
    own = ["_shard", "_bin", "_part"]
    rank = F.row_number().over(Window.partitionBy(*own).orderBy("_h", "_g", F.col("row").getField(key)))
    out = placed(keyed).withColumn("_rank", rank).join(F.broadcast(firsts), own)
    return unboxed(out, docs, shard=F.col("_shard").cast("int"), slot=(F.col("_first") + F.col("_rank") - 1).cast("long"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard under the law ``bytes``."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", (bytes_of() + 1).alias("size"), F.crc32(text_or_empty()).alias("text_crc32")
    )
    return histogram_sort(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
