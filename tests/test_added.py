"""Positional pairing, caches, guards, indexes, outlines and the whole chain."""

from __future__ import annotations

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from talkframe.functions import values as v
from talkframe.operators import cleaning as c
from talkframe.operators import datasets as ds
from talkframe.operators import dictionary as d
from talkframe.operators import evaluation as e
from talkframe.operators import maintenance as m
from talkframe.operators import outline as ol
from talkframe.operators import relational as r
from talkframe.sources import readers


def test_lines_pair_by_number_however_files_are_split(spark, tmp_path):
    rng = random.Random(1)
    lines = [f"t{i} " + "x" * rng.randrange(200) for i in range(400)]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"output": t}) for t in lines) + "\n\n")
    (tmp_path / "b.jsonl").write_text("\n\n".join(json.dumps({"output": t[::-1] * 3, "input": "q"}) for t in lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        a, b = (readers.one_field(spark, str(tmp_path / f"{n}.jsonl"), "output").withColumnRenamed("output", n) for n in "ab")
        assert a.rdd.getNumPartitions() != b.rdd.getNumPartitions() > 2
        got = sorted(map(tuple, e.paired(a, b).collect()))
        both = readers.combined(spark, str(tmp_path / "b.jsonl")).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, t, t[::-1] * 3) for i, t in enumerate(lines)]
    assert [(x["row_id"], x["input"], x["output"], x["prediction"]) for x in both] == [(i, "q", t[::-1] * 3, "") for i, t in enumerate(lines)]


def test_several_files_are_numbered_in_order(spark, tmp_path):
    for name, n in (("1", 3), ("2", 2)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"text": f"{name}-{i}"}) + "\n" for i in range(n)))
    got = readers.one_field(spark, str(tmp_path / "*.jsonl")).orderBy("row_id").collect()
    assert [(x[0], x[1]) for x in got] == list(enumerate(["1-0", "1-1", "1-2", "2-0", "2-1"]))


def plain_pairing(stems, own, metadata):
    out = {}
    for stem in stems:
        text = own.get(stem, "").strip()
        if stem not in own:
            for file in sorted({f for f, _, _ in metadata}):
                for _, _, line in sorted(x for x in metadata if x[0] == file):
                    cut = min((line.index(x) for x in "\t,|" if x in line), default=None)
                    if cut is not None and stem in line[:cut]:
                        text = line[cut + 1 :].strip()
                        break
        out[stem] = text or None
    return out


def test_lines_that_hold_a_stem(spark):
    stems = ["a.b", "rec 7", "clip_0001", "clip_00012", "x", "very-long-stem-name-01", "none", "own", "empty"]
    own = {"own": "mine", "empty": " "}
    metadata = [
        ("1.txt", 1, "wav/clip_00012.wav\tTwelve"), ("1.txt", 2, "dir/a.b.wav|dotted, text"), ("1.txt", 3, "rec 7.flac, seven | eight"), ("1.txt", 4, "no separator clip_0001"),
        ("2.csv", 1, "pre-very-long-stem-name-01-post|long"), ("2.csv", 2, "clip_0001.wav,Second"), ("2.csv", 3, "clip_0001.wav,Third"), ("1.txt", 5, "own.wav|other"), ("2.csv", 4, "zz|x in the text only"),
    ]
    audio = spark.createDataFrame([(s, s) for s in stems], "stem string, path string")
    got = ds.pair_by_stem(audio, spark.createDataFrame(list(own.items()), "stem string, text string"), spark.createDataFrame(metadata, "file string, line_no int, line string"))
    want = plain_pairing(stems, own, metadata)
    assert {x["stem"]: x["text"] for x in got.collect()} == want and sum(map(bool, want.values())) == 6


@pytest.mark.parametrize("parts", [None, 4])
def test_places_of_a_repeated_key(spark, parts):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 97 != 1, F.col("id") % 50).alias("k"))
    got = sorted((x["n"], x["k"]) for x in ds.placed(rows, "k", parts).collect())
    assert [n for n, _ in got] == list(range(4000))
    keys = [k for _, k in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))


def test_values(spark):
    row = spark.range(1).select(
        v.decay(F.lit(2.0), F.lit(3)).alias("a"), v.new_id().alias("b"), v.stable_id(F.lit("x"), F.lit(1)).alias("c"), v.stable_id(F.lit("x"), F.lit(1)).alias("d"), v.stable_id(F.lit("x1")).alias("e"),
        v.mapped(F.lit("q"), {"p": "1"}, "0").alias("f"), v.mapped(F.lit(None).cast("string"), {"p": "1"}).alias("g"), c.app_tone(F.lit("com.discord")).alias("h"),
    ).first()
    assert abs(row["a"] - 2 * 0.92**2) < 1e-12 and uuid.UUID(row["b"]) and uuid.UUID(row["c"]).version == 3 and row["c"] == row["d"] != row["e"]
    assert (row["f"], row["g"], row["h"]) == ("0", None, "casual")


def test_guards_and_caches(spark):
    rows = spark.createDataFrame([(1, "team", "owner"), (2, "all", None), (3, None, "admin")], "id int, scope string, role string")
    assert {x["id"]: x["errors"] for x in r.guarded(rows).collect()} == {1: ["role"], 2: ["scope"], 3: []}
    cache = spark.createDataFrame([("a", "A."), ("a", "A!")], "text string, value string")
    texts = spark.createDataFrame([("a",), ("b",), (None,)], "text string")
    assert [x[0] for x in r.looked_up(texts, cache).collect()].count("A.") == 1 and {x[0] for x in r.looked_up(texts, cache).collect()} == {"A.", "b", None}


def test_words_that_corrections_replace(spark):
    rows = [("open servis now", "open Service now")] * 3 + [("a servis b c", "a Service b d")] * 2 + [("one two", "one")] + [(None, "x"), ("same", "same")]
    got = {tuple(x) for x in d.replaced_words(spark.createDataFrame(rows, "raw_text string, text string"), least=2).collect()}
    assert got == {("servis", "Service", 5), ("c", "d", 2)}
    edits = spark.createDataFrame([("a b", "a b zed", "edited"), (None, "Zed a", "edited"), ("", "zed", "approved")], "model_output string, user_edit string, user_action string")
    assert [tuple(x) for x in r.edited_words(edits).collect()] == [("zed", 2)]


def test_both_indexes_are_replaced_by_project(spark, tmp_path):
    first, second = str(tmp_path / "first"), str(tmp_path / "second")
    ddl = "file_path string, symbol_type string, symbol_name string, line_number int, signature string"
    one = spark.createDataFrame([("a.py", "class", "A", 1, "s"), ("a.py", "class", "A", 1, "t")], ddl)
    m.write_indexes(one, "u", "p", first, second)
    m.write_indexes(one.limit(1), "u", "q", first, second)
    m.write_indexes(spark.createDataFrame([("b.py", "func", "bb", 2, "s")], ddl), "u", "p", first, second)
    read = lambda p: sorted((x["project_path"], x["symbol_name"]) for x in spark.read.parquet(p).collect())
    assert read(first) == read(second) == [("p", "bb"), ("q", "A")]
    assert spark.read.parquet(first).columns == list(m.FIRST_INDEX)


SOURCES = {
    "a.swift": """import Core
// class Fake {
public final class Alpha<T>: Base, Shown where T: Equatable {
    let name: String = "{"
    struct Inner { var xy: Int }
    class func make(a: Int) -> Alpha {
        func nested() {}
    }
}
protocol Speaker {
    func speak() -> String
}
""",
    "b.ts": """import a from "@scope/pkg/x"
import { b } from './local'
export default class Shape extends Base implements One, Two {
  x = { a: 1 }
  async area(
    n: number,
  ): Promise<number> {
    if (n) { for (;;) { } }
  }
}
const f = function inner() {}
export function load(x: string): void { }
""",
    "c.kt": "import a.b.C\ndata class User(val id: Int)\nclass Repo : Base() {\n  fun <T> find(x: T): T { return x }\n}\n",
    "d.go": 'import (\n  "fmt"\n)\ntype Shape interface {\n  Area() float64\n}\ntype ID int\nfunc (p *Point) Move(x int) (int, error) {\n  f := func(a int) { }\n}\n',
    "e.py": "class Ignored: pass",
}


def test_outlines(spark):
    files = spark.createDataFrame([*SOURCES.items(), ("n.go", None)], "path string, text string")
    got = {(x["path"], x["symbol_name"]): x for x in ol.outline(files).collect()}
    place = lambda path, name: tuple(got[path, name][k] for k in ("symbol_type", "line_number", "end_line", "parent_symbol"))
    assert set(got) == {
        ("a.swift", "Alpha"), ("a.swift", "Inner"), ("a.swift", "make"), ("a.swift", "Speaker"), ("a.swift", "speak"), ("b.ts", "Shape"), ("b.ts", "area"), ("b.ts", "load"),
        ("c.kt", "User"), ("c.kt", "Repo"), ("c.kt", "find"), ("d.go", "Shape"), ("d.go", "ID"), ("d.go", "Move"),
    }
    assert place("a.swift", "Alpha") == ("class", 3, 9, None) and place("a.swift", "make") == ("func", 6, 8, "Alpha") and place("a.swift", "speak") == ("func", 11, 11, "Speaker")
    assert place("b.ts", "Shape") == ("class", 3, 10, None) and place("b.ts", "area") == ("func", 5, 9, "Shape") and place("b.ts", "load") == ("func", 12, 12, None)
    assert place("c.kt", "User") == ("class", 2, 2, None) and place("c.kt", "find") == ("func", 4, 4, "Repo")
    assert place("d.go", "Shape") == ("interface", 4, 6, None) and place("d.go", "ID") == ("struct", 7, 7, None) and place("d.go", "Move") == ("func", 8, 10, None)
    alpha, make, shape = got["a.swift", "Alpha"], got["a.swift", "make"], got["b.ts", "Shape"]
    assert (alpha["parent_class"], alpha["conformances"], alpha["imports"], len(alpha["properties"])) == ("Base", "Shown", ["Core"], 1)
    assert (make["signature"], make["return_type"], make["is_static"]) == ("class func make(a: Int) -> Alpha", "Alpha", True)
    assert (shape["parent_class"], shape["conformances"], shape["imports"]) == ("Base", "One, Two", ["@scope/pkg"]) and got["b.ts", "area"]["return_type"] == "Promise<number>"


def test_the_whole_chain(spark):
    rows = spark.createDataFrame(
        [(1, "Şey, PasteService aç", "engineering", "u", "never"), (2, "Şey, PasteService aç", "general", "u", "PasteService'i aç."), (3, "şey var", "general", "u", "far too long an answer"),
         (4, "şey", "it_dataset", "u", "x"), (5, "PasteService aç", "engineering", None, None)],
        "id int, text string, mode string, user_id string, answer string",
    )
    symbols = spark.createDataFrame([(1, "PasteService", "class", "a/p.py", 9)], "id int, symbol_name string, symbol_type string, file_path string, line_number int")
    out = {x["id"]: x for x in c.clean(rows, symbols=symbols, corrected="answer", enabled=F.col("id") != 1).collect()}
    assert [out[i]["text"] for i in range(1, 6)] == ["Şey, @a/p.py aç", "PasteService'i aç.", "Var", "şey", "PasteService aç"]
    assert [out[i]["was_corrected"] for i in range(1, 6)] == [False, True, False, False, False]
    assert out[1]["symbol_refs"] == {"PasteService": "a/p.py:9"} and not out[2]["symbol_refs"] and out[1]["raw_text"].startswith("Şey")


def test_audio_files(spark, tmp_path):
    for name in ("a/one.wav", "a/b/two.mp3", "three.txt", "four.FLAC.flac"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 5)
    got = sorted((x["stem"], x["length"]) for x in readers.audio_files(spark, str(tmp_path)).collect())
    assert got == [("four.FLAC", 5), ("one", 5), ("two", 5)]
