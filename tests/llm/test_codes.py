"""Codes of vectors against plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from talkframe.llm.vector_codes import Codebooks, compressed, encoded, learned


def plain(rows: list[tuple], scale: int, parts: int, entries: int, rounds: int) -> list[tuple]:
    """vec_id, label, code, error, label_error and digest, by the words of the contract."""
    kept = [(i, v, lab) for i, v, lab in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = [[[math.floor(scale * x) for x in v[p * w : p * w + w]] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            of = [nearest(c[p], book)[1] for c in cut]
            books[p] = [[sum(col) // len(col) for col in zip(*own, strict=True)] if (own := [c[p] for c, o in zip(cut, of, strict=True) if o == e]) else book[e] for e in range(len(book))]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    total: dict = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        total[lab] = total.get(lab, 0) + e
    return [(i, lab, "".join(f"{e:02x}" for _, e in f), err, total[lab], digest) for (i, _, lab), f, err in zip(kept, found, errors, strict=True)]


def same(spark, rows, scale, parts, entries, rounds):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, vector array<double>, label int, code string").repartition(3)
    got = [tuple(r) for r in compressed(df, scale, parts, entries, rounds).collect()]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(plain(rows, scale, parts, entries, rounds), key=key)
    return got


def test_random_vectors_ties_and_repeats(spark):
    rng = random.Random(1)
    rows = [(i * 3 - 40, [rng.gauss(0, 0.3) for _ in range(16)], rng.choice([None, 0, 1])) for i in range(150)]
    rows += [(1000 + i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(16)], 2) for i in range(100)]  # ties
    rows += rows[:5] + [(None, rows[7][1], None), (5000, rows[0][1], 9)]
    same(spark, rows, 4096, 8, 16, 6)
    same(spark, rows, 1, 4, 16, 2)


def test_odd_vectors_take_no_part(spark):
    odd = [(-9, None, 1), (-8, [], 1), (-7, [1.0] * 7, 1), (-6, [math.nan] + [0.0] * 7, 1), (-5, [math.inf] * 8, 1), (-4, [None] + [0.0] * 7, 1), (9, [0.0] * 16, 1)]
    rows = [(1, [0.25 * i for i in range(8)], None), (2, [-0.25 * i for i in range(8)], 3), (2, [0.1] * 8, 3)]
    assert len(same(spark, odd + rows, 4096, 8, 16, 6)) == 3  # fewer than the entries
    assert same(spark, odd[:6], 4096, 8, 16, 6) == []
    assert same(spark, [], 4096, 8, 16, 6) == []


def test_components_that_need_more_than_64_bits(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([2e8, -4e8, 7.5, 5e8]) * rng.random() for _ in range(8)], i) for i in range(40)]
    assert all(r[3] < 2**63 - 1 for r in plain(rows, 1, 4, 16, 3))
    same(spark, rows, 1, 4, 16, 3)
    huge = spark.createDataFrame([(1, [1e300] * 8, 0), (2, [-1e300] * 8, 0), (3, [0.0] * 8, 1)], "vec_id long, vector array<double>, label int")
    assert {r["code"] for r in compressed(huge, rounds=1).collect()} == {"00" * 8, "01" * 8, "02" * 8}


@pytest.mark.parametrize("bits", [0, 1, 3, 6])
def test_bounds_leave_out_what_cannot_be_nearest(bits):
    rng = np.random.default_rng(3)
    middles = rng.integers(-4000, 4000, (16, 64))
    books = Codebooks(np.stack([middles[:, 8 * p : 8 * p + 8] for p in range(8)]), bits)
    vectors = middles[rng.integers(0, 16, 500)] + rng.integers(-300, 300, (500, 64))
    codes, errors, measured = books.nearest(vectors)
    gaps = ((vectors.reshape(500, 8, 1, 8) - books.entries[None]) ** 2).sum(axis=3)
    assert (codes == gaps.argmin(axis=2)).all() and (errors == gaps.min(axis=2)).all()
    assert measured == 500 * 8 * 16 if bits == 0 else measured <= 500 * 8 * (16, 16, 0, 6, 0, 0, 2)[bits]


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, [0.5] * 8, "a", 1.0), (2, [0.25] * 8, "b", 2.0)], "vec_id long, vector array<double>, row string, Error double")
    got = encoded(df, learned(df))
    assert got.columns == ["vec_id", "row", "code", "error"]
    assert sorted(map(tuple, got.collect())) == [(1, "a", "00" * 8, 0), (2, "b", "01" * 8, 0)]
