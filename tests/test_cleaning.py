"""The cleaning chain on hand-made texts."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from talkframe.operators import cleaning as c
from talkframe.operators.dictionary import Substitution, apply_dictionary, apply_small_dictionary


def each(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in rows.select("i", f(F.col("text")).alias("t")).orderBy("i").select("t").collect()]


FILLERS = [
    ("Şey, yarın gelirim.", "Yarın gelirim."),
    ("yani şey toplantı var", "Toplantı var"),
    ("Toplantı var, yani, saat üçte.", "Toplantı var, saat üçte."),
    ("Bana bir şey söyle.", "Bana bir şey söyle."),
    ("Hiç şey almadım yani.", "Hiç şey almadım."),
    ("500 kişi, yani yarısı geldi.", "500 kişi, yani yarısı geldi."),
    ("Müsaitsen, yani gelirsen sevinirim", "Müsaitsen, gelirsen sevinirim"),
    ("var yani şimdi", "Var şimdi"),
    ("Evet hmm tamam", "Evet tamam"),
    ("İşte geldik. Hani bekle.", "İşte geldik.bekle."),  # the blank goes with a starter
    ("nothing here", "Nothing here"),
    ("  ", "  "),
    ("", ""),
    (None, None),
    ("son,,", "Son."),
    ("o şey yani güzel", "O şey yani güzel"),  # a protected noun ends in no letter a rule looks for
]


def test_fillers(spark):
    got = each(spark, [t for t, _ in FILLERS], c.clean_fillers)
    assert got == [w for _, w in FILLERS]


def model_of_loops(text: str, repeats: int = 3) -> str:
    said = text.split()
    if len(said) < 2 * repeats:
        return text
    for n in (1, 2, 3):
        for i in range(len(said)):
            copies = 0
            while said[i + n * (copies + 1) : i + n * (copies + 2)] == said[i : i + n] and len(said[i : i + n]) == n:
                copies += 1
            if copies >= repeats:
                return " ".join(said[:i])
    return text


LOOPS = [
    "yar yar yar yar yar yar", "ben geldim geldim geldim geldim geldim bitti", "a b a b a b a b a b son", "x a b c a b c a b c a b c y",
    "bir iki üç dört beş altı", "bir bir bir bir", "", "a a a b b b c c c", "işte İşte işte işte işte işte", "p q  q q\nq r s t",
]


def test_loops(spark):
    assert each(spark, LOOPS, c.strip_loops) == [model_of_loops(t) for t in LOOPS]


def test_phantom_phrases(spark):
    texts = ["Merhaba. İzlediğiniz için teşekkürler.", "Thank you for watching", "please subscribe later", "Bye, Thanks for watching. .", ""]
    assert each(spark, texts, c.strip_phantom_phrase) == ["Merhaba", "", "please subscribe later", "Bye", ""]


DICTIONARY = [("servis", "Service"), ("yuzir servis", "UserService"), ("kod", "servis kodu"), ("", "x"), ("boş", " "), ("a.b", "$1\\x"), ("servis", "second")]
SUBSTITUTED = [
    ("servis", "Service"), ("SERVİS değil Servis", "SERVİS değil Service"), ("servisler kodlar", "servisler kodlar"),
    ("yuzir servis açık", "UserService açık"), ("bir yuzir servis", "bir UserService"), ("kod", "Service kodu"), ("", ""),
    ("(servis),servis_servis", "(Service),Service_Service"), ("a.b a-b", "$1\\x a-b"), (None, None),
]


def test_dictionary(spark):
    got = each(spark, [t for t, _ in SUBSTITUTED], lambda t: apply_dictionary(t, DICTIONARY))
    # The dotted capital folds to a plain i, so that it matches as well.
    assert got == [w.replace("SERVİS", "Service") if w else w for _, w in SUBSTITUTED]


def test_dictionary_without_the_library(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    plain = Substitution(DICTIONARY)
    assert plain.automaton is None and plain.apply("yuzir servis, kod") == "UserService, Service kodu"


def test_small_dictionary(spark):
    assert each(spark, ["that THAT thatx a$b"], lambda t: apply_small_dictionary(t, [("that", "x\\$1"), ("a$b", "y")])) == ["x\\$1 x\\$1 thatx y"]


def test_segments(spark):
    def plan(intervals, total):
        row = spark.range(1).select(c.plan_segments(F.array(*(F.struct(F.lit(float(s)).alias("s"), F.lit(float(e)).alias("e")) for s, e in intervals)).cast("array<struct<s:double,e:double>>"), F.lit(float(total))).alias("p")).first()[0]
        return [(round(x["s"], 3), round(x["e"], 3), x["is_cmd"]) for x in row]

    def model(intervals, total):
        out, prev = [], 0.0
        for s, e in sorted(intervals):
            s, e = max(0.0, min(s, total)), max(0.0, min(e, total))
            out += [(prev, s, False)] * (s > prev + 0.3) + [(s, e, True)] * (e > s + 0.3)
            prev = e
        return out + [(prev, float(total), False)] * (prev + 0.3 < total)

    for intervals, total in (([(1, 2), (4, 5)], 6), ([(4, 5), (1, 2)], 5.2), ([(0, 9), (1, 2)], 4), ([(0.1, 0.2)], 0.35), ([], 3)):
        assert plan(intervals, total) == model(intervals, total)


def test_interval_header(spark):
    rows = spark.createDataFrame([("1.10-2.30,4.50-5.10",), ("1-2,x",), ("",), (None,)], "h string").select(c.parse_intervals(F.col("h"))).collect()
    assert [r[0] and [tuple(x) for x in r[0]] for r in rows] == [[(1.1, 2.3), (4.5, 5.1)], None, None, None]


def test_guards_and_references(spark):
    rows = spark.createDataFrame([("text", "text fixed"), ("text", ""), ("text", "much longer than the text"), ("text", None), ("  ", "x")], "a string, b string")
    assert [r[0] for r in rows.select(c.guard_correction(F.col("a"), F.col("b"))).collect()] == ["text", "text", "text", "text", "  "]
    assert [r[0] for r in rows.limit(1).select(c.guard_correction(F.col("a"), F.lit("texts"), F.lit(False))).collect()] == ["text"]
    got = spark.range(1).select(c.references(F.lit("see @a/b.py:3 Name and @c/ and @a/b.py"))).first()[0]
    assert got == {"Name": "a/b.py:3", "c": "c/"}


def test_chain_by_mode(spark):
    rows = spark.createDataFrame(
        [(1, "Şey, servis", "general", "u"), (2, "Şey, servis", "engineering", "u"), (3, "Şey, servis", "it_dataset", "u"), (4, "imza.", "general", "u"), (5, "imza", "general", None)],
        "id int, text string, mode string, user_id string",
    )
    snippets = spark.createDataFrame([("İmza", "Saygılarımla", 1), ("imza", "Best regards", 0)], "trigger_phrase string, expansion string, ord int")
    entries = spark.createDataFrame([("servis", "Service", 0)], "trigger string, replacement string, ord int")
    out = {r["id"]: r for r in c.clean(rows, entries, snippets).collect()}
    assert [out[i]["text"] for i in range(1, 6)] == ["Service", "Şey, Service", "Şey, servis", "Best regards", "Imza"]
    assert [out[i]["was_corrected"] for i in (1, 3)] == [True, False] and out[4]["snippet_used"]


