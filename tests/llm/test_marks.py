"""Near-duplicates through fingerprints, and marks that rule pairs out."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from talkframe.llm import graph, simhash


def test_marks_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(1)
    ruled_out = 0
    for _ in range(300):
        n, m, both = rng.integers(0, 400), rng.integers(0, 4000), rng.integers(0, 400)
        every = rng.integers(0, 1 << 63, n + m + both, dtype=np.uint64)
        a, b = np.unique(every[: n + both]), np.unique(every[n:])
        apart = len(np.setxor1d(a, b))
        least = simhash._least_apart(simhash._marks(a), simhash._marks(b))
        assert least <= apart and (least - apart) % 2 == 0
        ruled_out += least > (len(a) + len(b)) / 9
    assert ruled_out > 100


def test_set_fingerprint_is_a_majority_of_bits():
    rng = random.Random(2)
    for n in (0, 1, 2, 7, 300):
        hashes = [rng.getrandbits(64) for _ in range(n)]
        want = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > n)
        assert simhash._set_fingerprint(np.array(hashes, np.uint64)) == (want - (1 << 64) if want >> 63 else want)


def test_near_copies_are_candidates_by_their_fingerprints(spark, monkeypatch):
    """Without the prefix filter the fingerprints' links alone find the copies of a few changed words."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    rows = []
    for i in range(10):
        base = rng.choices(vocabulary, k=900)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base, rng.choice(vocabulary)]))]
    found = simhash._candidates
    monkeypatch.setattr(simhash, "_candidates", lambda *a, **k: found(*a, **k).where("false"))
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(10)) >= 8 and all(got[k] in (k, k - k % 2) for k in got)


@pytest.mark.parametrize("part, left", [(4096, 10_000), (16, 10_000), (16, 0)])  # one block, many blocks, many with too many pairs
def test_large_crowds_meet_by_their_marks(spark, monkeypatch, part, left):
    """What marks leave of a crowd is all that may be similar: listed pairs are just those, stars join them all."""
    monkeypatch.setattr(simhash, "MARKS_PART", part)
    monkeypatch.setattr(simhash, "PAIRS_LEFT", left)
    rng = np.random.default_rng(4)
    sets = []
    for n in (1, 3, 5, 30, 31, 60, 64, 120, 1000, 40_000):  # widths of marks change between some, and end at the widest
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets += [np.unique(base), np.unique(base[: n - n // 7]), *(np.unique(np.concatenate((base[n // 20 :], rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)))) for _ in range(4))]
    marks = [(i, len(x), bytearray(simhash._marks(x))) for i, x in enumerate(sets)]
    crowds = spark.createDataFrame([(c, i) for c in (7, -3) for i in range(len(sets)) if c > 0 or i < 20], "crowd long, node long")
    got = simhash._thinned(crowds, spark.createDataFrame(marks, "node long, n int, marks binary"), 0.8).collect()
    may = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if simhash._least_apart(bytes(marks[i][2]), bytes(marks[j][2])) <= (len(sets[i]) + len(sets[j])) / 9 + 1e-6}
    may = {(i, j) for i, j in may if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) - 1e-6}
    assert {(r["a"], r["b"]) for r in got if not r["crowded"]} <= may and any(r["crowded"] for r in got) == (left == 0)
    if left:
        assert {(r["a"], r["b"]) for r in got} == may
    roots = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame([(r["a"], r["b"]) for r in got], "a long, b long")).collect()}
    assert all(roots[i] == roots[j] for i, j in may) and len(may) > 40


def test_a_common_key_does_not_send_a_chain_of_texts_to_blocks(spark, monkeypatch):
    """Texts that hang together, hardly any two similar, where one key has more than ``most`` members: no large crowd is left to blocks of texts."""
    monkeypatch.setattr(simhash, "PART", 4)
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    phrases = [" ".join(rng.choices(vocabulary, k=10)) for _ in range(8)]
    rows = [(i, f"{phrases[i % 8]} {phrases[i // 8 % 8]} {' '.join(rng.choices(vocabulary, k=2))}") for i in range(120)]
    rows += [(200 + i, f"{t} {vocabulary[i]}") for i, (_, t) in enumerate(rows[:3])]
    sizes, keys, blocks, candidates = [], [], simhash._blocks, simhash._candidates

    def seen(crowds, *a):
        sizes.extend(r["count"] for r in crowds.groupBy("crowd").count().collect())
        return blocks(crowds, *a)

    def found(*a, **k):
        out = candidates(*a, **k)
        keys.append(out.where("crowded").count())
        return out

    monkeypatch.setattr(simhash, "_blocks", seen)
    monkeypatch.setattr(simhash, "_candidates", found)
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), most=4).collect()}
    text = dict(rows)
    alike = [(a, b) for a, b in itertools.combinations(text, 2) if simhash.shingle_similarity(text[a], text[b]) >= 0.8]
    roots = {k: k for k in text} | {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(alike, "a long, b long")).collect()}
    assert keys[0] and got == roots and max(sizes, default=0) <= 8
