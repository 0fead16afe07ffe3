"""Bit-parallel edit distances and counts against the whole matrix."""

from __future__ import annotations

import random

import pytest

from talkframe.functions import edits


def plain(a, b):
    """The distance, and all (substitutions, insertions, deletions) that shortest ways have."""
    row = [(j, {(0, j, 0)}) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [(i, {(0, 0, i)})]
        for j, y in enumerate(b, 1):
            ways = [(row[j - 1][0] + (x != y), {(s + (x != y), n, d) for s, n, d in row[j - 1][1]}), (row[j][0] + 1, {(s, n, d + 1) for s, n, d in row[j][1]}), (new[-1][0] + 1, {(s, n + 1, d) for s, n, d in new[-1][1]})]
            least = min(w[0] for w in ways)
            new.append((least, set().union(*(w[1] for w in ways if w[0] == least))))
        row = new
    return row[-1]


@pytest.mark.parametrize(("block", "kept"), [(8192, 1 << 20), (3, 16), (1, 1), (7, 40)])
def test_counts_are_those_of_a_shortest_way(monkeypatch, block, kept):
    monkeypatch.setattr(edits, "BLOCK", block)
    monkeypatch.setattr(edits, "KEPT", kept)
    rng = random.Random(block)
    for _ in range(400):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 14))) for _ in range(2))
        if rng.random() < 0.3:
            b = a[:5] + b + a[5:]
        distance, ways = plain(a, b)
        assert edits.edit_distance(a, b) == distance and edits.edit_counts(a, b) in ways
        assert edits.edit_counts(list(a), list(b)) == edits.edit_counts(a, b)


def test_long_texts_in_linear_memory():
    import tracemalloc

    rng = random.Random(3)
    a = "".join(rng.choices("abcdefghij ", k=30_000))
    b = "".join(c for c in a if rng.random() > 0.02).replace("ab", "ba")
    tracemalloc.start()
    counts = edits.edit_counts(a, b)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20  # all columns would be 225 MB
    tracemalloc.stop()
    assert sum(counts) == edits.edit_distance(a, b) and counts[1] - counts[2] == len(b) - len(a)


def test_null_texts(spark):
    rows = spark.createDataFrame([("a b c", "a x c d"), (None, "a"), ("a", None), ("", "")], "a string, b string")
    from pyspark.sql import functions as F

    assert [r[0] and tuple(r[0]) for r in rows.select(edits.counted_edits(F.col("a"), F.col("b"), True)).collect()] == [(1, 1, 0), None, None, (0, 0, 0)]
