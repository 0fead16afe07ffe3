"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import checkpointed, tidy


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Every node a of (a, b) hands its ``larger`` or its smaller neighbours b to the smallest of them and itself.

    Of smaller ones the node hands over itself too. One exchange brings a node's rows together in the order of b, so that
    the first row has the smallest and rows pass by in batches, however many a node has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = last = least = None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch.column(i).to_numpy() for i in range(2))
            first = np.concatenate(([node is None or a[0] != node], a[1:] != a[:-1]))
            again = ~first & (b == np.concatenate(([b[0] if last is None else last], b[:-1])))
            starts = np.flatnonzero(first)
            m = np.concatenate(([0 if least is None else least], np.minimum(a[starts], b[starts])))[np.cumsum(first)]
            node, last, least = a[-1], b[-1], m[-1]
            own = ~again & ((b > a) if larger else (b != m))
            x, y = b[own], m[own]
            if not larger:
                x, y = np.concatenate((x, a[starts])), np.concatenate((y, m[starts]))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return edges.repartition("a").sortWithinPartitions("a", "b").mapInArrow(tidy(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and root, its component's smallest node, for every node of ``edges`` (a, b longs).

    Rounds of large-star and small-star: every node hands its larger neighbours, then its
    smaller ones, to the smallest node next to it, until all hang on their roots. Each star is
    one exchange; rounds grow with the logarithm of the components, and what a round leaves is
    counted while it is written. Self-loops and repeated edges do no harm. Nodes without an
    edge are not in the result.
    """
    edges_ = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    before, after = None, None
    while before is None or (after[0] and after != before):
        before, seen = after or (), Observation()
        both = edges_.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        stars = _stars(_stars(both, larger=True), larger=False)
        edges_ = checkpointed(stars.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")))
        after = (seen.get["n"], seen.get["h"])
    roots = edges_.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges_.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
