"""Dictionaries of many users at once against one call a user."""

from __future__ import annotations

import random

import pytest

from talkframe.operators import lexicons as lx
from talkframe.operators.dictionary import Substitution

ENTRIES = [
    ("a", "servis", "Service", 1), ("a", "paste servis", "PasteService", 2), ("b", "servis", "servant", 3), (None, "servis", "everyone's", 4), (None, "c++", "C plus plus", 5), (None, ".net", "dot net", 6),
    ("a", "İstanbul", "city", 7), ("b", "one two three four five", "5", 8), ("b", "one two", "2", 9), ("b", "->", "arrow", 10), ("a", "x", "servis", 11), ("a", " ", "blank", 12), ("a", "blank", "  ", 13),
    ("a", "SERVIS", "later", 14), ("b", "e", "é", 15), (None, "-", "minus", 16),
]
TEXTS = [
    "paste servis and servis", "Paste  Servis", "İSTANBUL'da servis", "c++ c+++ xc++", "a .net b.net", "one two three four fivesix one two three four five", "a -> b->c --> d", "x", "servis-servis_servis", "", " ", "résumé e é", None,
]


def one_call_a_user(rows, entries):
    made = {u: Substitution([(t, r) for o, t, r, _ in sorted(entries, key=lambda e: (e[3], e[0] is None)) if o in (u, None)]) for u in {u for u, _ in rows}}
    return [(u, t if u is None or t is None else made[u].apply(t)) for u, t in rows]


@pytest.mark.parametrize("slice_", [lx.SLICE, 20])
def test_as_one_call_a_user(spark, monkeypatch, slice_):
    monkeypatch.setattr(lx, "SLICE", slice_)  # few characters: every owner's sides are dealt into slices
    rng = random.Random(5)
    rows = [(u, t) for t in TEXTS for u in ("a", "b", "c", None)] + [("a", TEXTS[0])] * 3
    words = ["ab", "ba", "a", "b", "-", ".", " ", "_", "é", "9", "  ", "AB"]
    entries = ENTRIES + [(rng.choice(["a", "b", None]), "".join(rng.choices(words, k=rng.randint(1, 5))), rng.choice(["ab", "Q", "b-a"]), 100 + i) for i in range(120)]
    rows += [(rng.choice("abc"), "".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(150)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "user_id string, text string, id int")
    got = lx.apply_by_user(df, spark.createDataFrame(entries, "user_id string, trigger string, replacement string, ord int"))
    assert got.columns == df.columns
    assert [r["text"] for r in sorted(got.collect(), key=lambda r: r["id"])] == [t for _, t in one_call_a_user(rows, entries)]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_no_entries_and_no_texts(spark):
    df = spark.createDataFrame([("a", "x y")], "user_id string, text string")
    none = spark.createDataFrame([], "user_id string, trigger string, replacement string")
    assert lx.apply_by_user(df, none).collect() == df.collect()
    assert lx.apply_by_user(df.limit(0), none).collect() == []
