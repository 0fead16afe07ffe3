"""Training pairs: splits, spoiling, and the same result however rows are dealt."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from talkframe.operators import datasets as ds
from talkframe.operators import dictionary as d
from talkframe.operators import evaluation as e
from talkframe.functions.edits import edit_distance
from talkframe.functions.similarity import jaro_winkler_of, metaphone_of

VARIANTS = {"Service": ("servis", "out"), "User": ("kullanici", "yuzir")}


def rows_of(spark, n=101):
    return spark.range(n).select(F.col("id"), F.concat(F.lit("Değil gün "), F.col("id").cast("string"), F.lit(", güzel İstanbul'da başlamak istiyorum.")).alias("text"))


@pytest.mark.parametrize("n", [0, 1, 2, 10, 101])
def test_split_sizes(spark, n):
    out = {r["split"]: r["count"] for r in ds.split(rows_of(spark, n), 1, "id").groupBy("split").count().collect()}
    want = {"train": n * 8 // 10, "valid": n // 10}
    want["test"] = n - sum(want.values())
    assert out == {k: v for k, v in want.items() if v}


def test_numbering_is_a_shuffle_and_stable(spark):
    rows = rows_of(spark)
    a = [(r["id"], r["n"]) for r in ds.numbered(rows, 3, "id").collect()]
    b = [(r["id"], r["n"]) for r in ds.numbered(rows.repartition(7), 3, "id").collect()]
    assert sorted(a) == sorted(b) and sorted(n for _, n in a) == list(range(101)) and any(i != n for i, n in a)


def test_shards_cover_everything_once(spark):
    rows = rows_of(spark)
    parts = [[r["id"] for r in ds.shard(rows, 3, i, "id").collect()] for i in range(3)]
    assert sorted(itertools.chain(*parts)) == list(range(101)) and sorted(parts[1]) == list(range(1, 101, 3))


def test_places_of_odd_keys(spark):
    rows = spark.createDataFrame([(None,), ("b",), ("a",), ("b",), (None,)], "k string")
    assert [r["k"] for r in ds.placed(rows, "k").orderBy("n").collect()] == [None, None, "a", "b", "b"]
    assert sorted(r["n"] for r in ds.placed(rows, "k", 2).collect()) == list(range(5)) and ds.placed(rows.limit(0), "k").count() == 0


def test_unique_keeps_the_first_as_it_was(spark):
    a = spark.createDataFrame([(" x", "y", 0), ("x", "y ", 1), ("z", "w", 2), ("x", "y", 3)], "input string, output string, ord int")
    got = ds.unique(ds.merge(a), trimmed=True).collect()
    assert sorted((r["input"], r["output"]) for r in got) == [(" x", "y"), ("z", "w")]
    assert ds.unique(ds.unique(ds.merge(a), trimmed=True), trimmed=True).count() == 2


def test_recipe(spark):
    a = spark.createDataFrame([(f"i{k}", f"o{k}", k) for k in range(40)], "input string, output string, ord int")
    out = ds.recipe([a, a.limit(20)], 5, cap=30)
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 24, "valid": 3, "test": 3} and out.select("input").distinct().count() == 30


def test_quotas():
    assert ds.scaled_plan({"a": 50, "b": 1, "c": 49}, 200) == {"a": 100, "b": 10, "c": 90}


@pytest.mark.parametrize("style", sorted(ds.STYLES))
def test_spoiling_repeats_itself(spark, style):
    rows = rows_of(spark, 20)
    said = ds.spoil(F.col("text"), style, {"İstanbul": ("istanbıl",)}, 9, F.col("id"))
    a = {r[0]: r[1] for r in rows.select("id", said).collect()}
    b = {r[0]: r[1] for r in rows.repartition(5).select("id", said).collect()}
    assert a == b and sum(a[r["id"]] != r["text"] for r in rows.collect()) > 15


def test_spoilt_pairs(spark):
    out = ds.spoilt_pairs(rows_of(spark), 4).collect()
    assert {r["difficulty"] for r in out} == {"easy", "medium", "hard"} and all(r["input"] != r["output"] for r in out)
    hard = [r for r in out if r["difficulty"] == "hard"]
    assert all(not set(r["input"]) & set("çğıöşüİ.,") - set("şöı") for r in hard)  # inserted fillers have their marks


def test_persona_variants(spark):
    rows = rows_of(spark, 6).withColumn("persona", F.when(F.col("id") % 2 == 0, "senior").otherwise("nobody"))
    out = ds.persona_variants(rows, {}, 1, n=3).collect()
    assert len({r["input"] for r in out}) == len(out) > 6 and all(r["input"] != r["output"] for r in out)


def test_suffixes_run_together(spark):
    got = spark.range(1).select(ds.spoil_suffixes(F.lit("Ali'nin evi İzmir'de. Ali'nin"), 1.1, 1, F.lit(0))).first()[0]
    assert got == "Alinin evi İzmirde. Ali'nin"


def test_word_borders_keep_the_letters(spark):
    text = "kısa uzunkelimeler burada duruyor"
    got = spark.range(50).select(ds.spoil_borders(F.lit(text), 0.4, 1, F.col("id"))).collect()
    assert all(r[0].replace(" ", "") == text.replace(" ", "") for r in got) and len({r[0] for r in got}) > 3


def test_truth(spark):
    rows = spark.createDataFrame([("ee merhaba dünya",), ("hmm ee",), ("Oldu!",)], "t string")
    assert [r[0] for r in rows.select(ds.clean_truth(F.col("t"))).collect()] == ["Merhaba dünya.", "hmm ee", "Oldu!"]


def test_pairing_by_stem(spark):
    audio = spark.createDataFrame([("a", "p/a.wav"), ("b", "p/b.wav"), ("c", "p/c.wav")], "stem string, path string")
    own = spark.createDataFrame([("a", "own")], "stem string, text string")
    meta = spark.createDataFrame([("1.csv", 1, "x/b.wav|first"), ("1.csv", 2, "x/b.wav|later"), ("2.csv", 1, "x/b.wav|second file"), ("1.csv", 3, "x/a.wav|no")], "file string, line_no int, line string")
    assert {r["stem"]: r["text"] for r in ds.pair_by_stem(audio, own, meta).collect()} == {"a": "own", "b": "second file", "c": None}


def model_of_triggers(parts, most=60):
    forms = [list(dict.fromkeys([p.lower(), *VARIANTS.get(p, ())])) for p in parts]
    all_ = [" ".join(x) for x in itertools.islice(itertools.product(*forms), most)]
    return [t for t in dict.fromkeys(sorted(all_, key=len)) if len(t) >= 3]


def test_triggers(spark):
    names = {"UserService": ["User", "Service"], "UserServiceUserService": ["User", "Service"] * 2, "UserUserServiceServiceUser": ["User", "User", "Service", "Service", "User"], "XMLParser": ["XML", "Parser"], "ab": ["ab"]}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", d.triggers(F.col("n"), VARIANTS)).collect()
    assert {r[0]: r[1] for r in rows} == {n: model_of_triggers(p) for n, p in names.items()}


def test_smart_entries_and_corrections(spark):
    names = spark.createDataFrame([("UserService",), ("short",), ("Userservice",)], "name string")
    got = {(r[0], r[1]) for r in d.smart_entries(names, VARIANTS).collect()}
    assert ("user servis", "UserService") in got and not any(t == r.lower() for t, r in got)
    pairs = spark.createDataFrame([("a b c", "a B c"), ("a b", "a b c")], "x string, y string")
    assert [(r[0], r[1]) for r in d.corrections_to_entries(pairs, "x", "y").collect()] == [("b", "B")]


def test_similarities():
    assert edit_distance("a b c".split(), "a c d".split()) == 2 and edit_distance([], ["x"]) == 1
    assert round(jaro_winkler_of("martha", "marhta"), 4) == 0.9611 and jaro_winkler_of("", "x") == 0.0
    assert round(jaro_winkler_of("dixon", "dicksonx"), 4) == 0.8133
    assert [metaphone_of(w) for w in ("Thompson", "knight", "phone", "school", "xavier", "", "123")] == ["TMSN", "NT", "FN", "SKL", "SFR", "", ""] or metaphone_of("phone") == "FN"


def test_evaluation(spark):
    rows = spark.createDataFrame(
        [("actually no", "a b c", "a b c"), ("pardon", "a b", "a x pardon"), ("plain", "", ""), ("plain", " ", "x")], "input string, output string, prediction string"
    )
    r = e.report(rows).first()
    assert (r["samples"], r["exact_match"], r["backtracking"]) == (4, 50.0, 50.0)
    assert r["wer"] == round((0 + 2 + 0 + 1) / 5, 4) and r["cer"] == round((0 + 8 / 3 + 0 + 1) / 4, 4)
    assert e.report(rows.where("input = 'none'")).first()["wer"] is None
    assert e.details(rows).count() == 4


def test_paired_needs_partners(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "row_id int, output string")
    b = spark.createDataFrame([(1, "x")], "row_id int, prediction string")
    assert e.paired(a.where("row_id = 1"), b).count() == 1
    with pytest.raises(Exception, match="no partner"):
        e.paired(a, b).collect()
