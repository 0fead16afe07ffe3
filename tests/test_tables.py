"""Tables, files, symbols and streams."""

from __future__ import annotations

import json

import random

import pytest
from pyspark.sql import functions as F

from talkframe import schemas
from talkframe.operators import maintenance as m
from talkframe.operators import matching as ma
from talkframe.operators import relational as r
from talkframe.operators import symbols as sy
from talkframe.sources import readers, writers
from talkframe.streaming import transcripts as st


def test_defaults_and_evolution(spark):
    rows = spark.createDataFrame([(1, "t")], "id int, TEXT string")
    out = schemas.defaults(rows, "transcriptions")
    assert out.columns == schemas.schema("transcriptions").names
    assert out.first()["tenant_id"] == "default" and out.first()["text"] == "t"
    assert schemas.evolve(rows, spark.createDataFrame([(2,)], "id int")).count() == 2


def test_statistics(spark):
    t = spark.createDataFrame(
        [("a", "x y", 1.0, "general", "u", "2024-01-30 00:00:00"), ("a", "", 2.0, None, "v", "2024-01-01 00:00:00"), ("b", "z", 9.0, "office", "w", "2024-01-30 00:00:00")],
        "tenant_id string, text string, duration double, mode string, user_id string, created_at string",
    ).withColumn("created_at", F.to_timestamp("created_at"))
    users = spark.createDataFrame([("u", "a"), ("w", "b")], "id string, tenant_id string")
    s = r.tenant_stats(t, users, "a", F.lit("2024-01-31").cast("timestamp")).first()
    assert (s["total"], s["total_words"], s["avg_duration"], s["active_users"], s["total_users"]) == (2, 3, 1.5, 1, 1)
    assert s["modes"] == {"general": 2, "engineering": 0, "office": 0}
    assert r.tenant_stats(t, users, "none", F.lit("2024-01-31").cast("timestamp")).first()["avg_duration"] == 0.0


def test_history_is_guarded(spark):
    t = spark.createDataFrame([(1, "a", "u", 1), (2, "a", "v", 2)], "id int, tenant_id string, user_id string, created_at int")
    assert [x["id"] for x in r.history(t, "a", "member", "u").collect()] == [1]
    assert [x["id"] for x in r.history(t, "a", "admin", "u").collect()] == [2, 1]
    with pytest.raises(PermissionError):
        r.history(t, "a", "member", "u", asked="v")


def test_changes(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert m.delete(t, F.col("v") == "a").count() == 1 and m.deleted_count(t, F.col("v") == "a").first()[0] == 1
    assert {tuple(x) for x in m.upsert(t, spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string"), ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    path = str(tmp_path / "t")
    t.write.parquet(path)
    m.replace(m.delete(spark.read.parquet(path), F.col("k") == 1), path)
    assert [x["k"] for x in spark.read.parquet(path).collect()] == [2]
    log = m.append_audit(spark.createDataFrame([], schemas.schema("audit_log")), "a", "u", "login", "x", F.current_timestamp())
    assert log.first()["action"] == "login"


def test_erasure(spark):
    rows = spark.createDataFrame([("a", "u"), ("a", "v"), ("b", "u")], "tenant_id string, user_id string")
    users = spark.createDataFrame([("u", "a", True), ("u", "b", True)], "id string, tenant_id string, is_active boolean")
    left, counts = m.erase_user({"transcriptions": rows, "audit_log": rows, "users": users}, "a", "u")
    assert left["transcriptions"].count() == 2 and left["audit_log"].count() == 3 and counts.first()["transcriptions"] == 1
    assert {(x["tenant_id"], x["is_active"]) for x in left["users"].collect()} == {("a", False), ("b", True)}


def test_feedback(spark):
    rows = spark.createDataFrame([("a", "b", "approved"), ("a", "b", "other"), (None, "b", "edited")], "raw_whisper string, model_output string, user_action string")
    assert [x["error"] for x in r.feedback(rows).collect()] == [None, "unknown action", "missing field"]


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"input": "x", "output": "y", "category": "c"}\n\nbad\n{"input": "only"}\n{"input": "ş", "output": ""}\n', encoding="utf-8")
    rows = readers.json_lines(spark, str(p))
    assert [(x["input"], x["output"], x["category"]) for x in rows.orderBy("ord").collect()] == [("x", "y", "c"), ("ş", "", None)]
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl")).count() == 0
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.strict_json_lines(spark, str(p)).collect()
    assert readers.raw_lines(spark, str(p)).count() == 4 and readers.one_field(spark, str(p), "input").count() == 4


def test_other_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "s.txt").write_text("a longer sentence\nshort\n")
    assert [x["text"] for x in readers.sentences(spark, str(tmp_path)).collect()] == ["a longer sentence"]
    (tmp_path / "b.json").write_text(json.dumps([{"trigger": "a", "replacement": "b"}, {"trigger": "c", "replacement": "d"}], indent=1))
    assert [tuple(x) for x in readers.json_array(spark, str(tmp_path / "b.json"), "trigger string, replacement string").collect()] == [(0, "a", "b"), (1, "c", "d")]
    src = tmp_path / "src"
    for name in ("app/a.py", "node_modules/x.py", ".git/y.py", "app/n.txt"):
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_text("class A:\n  def b(self): pass\n")
    files = sy.source_files(readers.source_tree(spark, str(src)))
    assert [x["path"] for x in files.collect()] == ["app/a.py"]
    out = tmp_path / "out"
    writers.splits(spark.createDataFrame([("x", "train"), ("y", "test")], "text string, split string"), str(out))
    assert spark.read.json(str(out)).count() == 2
    writers.report(spark.range(1), str(tmp_path / "r"))
    writers.append(spark.range(2), str(tmp_path / "app"))


def test_declarations(spark):
    code = {
        "a.swift": "import UIKit\n@objc public final class PasteService: Base, Saving {\n  override func run() {}\n}\nstruct P {}\n",
        "b.py": "class A(B):\n    def go(self): pass\nasync def top(): pass\nx = 1\n", "c.go": "type T struct {\nfunc (t *T) Do() {\ntype I interface {",
        "d.ts": "export abstract class C {}\nexport async function ff() {}\n", "e.kt": "data class D(val x: Int)\nsuspend fun work() {}\n", "f.py": "def broken(:\n",
    }
    files = spark.createDataFrame(list(code.items()), "path string, text string")
    got = {(x["path"], x["symbol_type"], x["symbol_name"], x["line_number"]) for x in sy.declarations(files).collect()}
    assert got == {
        ("a.swift", "class", "PasteService", 2), ("a.swift", "func", "run", 3), ("b.py", "func", "go", 2), ("b.py", "func", "top", 3),
        ("c.go", "func", "Do", 2), ("d.ts", "func", "ff", 2), ("e.kt", "func", "work", 2), ("f.py", "func", "broken", 1),
    }  # fmt: skip  names of one letter are left out
    assert [tuple(x) for x in sy.inheritance(files).collect()] == [("a.swift", "PasteService", "Base", "Saving")]
    trees = {(x["symbol_name"], x["symbol_type"], x["parent_symbol"]) for x in sy.python_symbols(files).collect()}
    assert trees == {("go", "func", "A"), ("top", "func", None)}


def test_report(spark):
    rows = spark.createDataFrame(
        [("UserService", "class", "a/u.py", 1, "Base", None, ["numpy.x", "os"]), ("F", "struct", "b.go", 2, None, None, [])],
        "symbol_name string, symbol_type string, file_path string, line_number int, parent_class string, conformances string, imports array<string>",
    )
    text = sy.report(rows, "p", "now").first()[0]
    assert "2 total (class: 1, struct: 1)" in text and "go (1), python (1)" in text and "- Service Layer" in text
    assert "numpy" in text and "| UserService | class | a/u.py:1 | Base | - |" in text and "### UserService" in text
    assert sy.report(rows.where("false"), "p", "now").count() == 0


def test_folder_scores():
    assert ma.folder_score("widget", "widgets") == 0.95 and ma.folder_score("widgets", "widgets") == 0.95
    assert ma.folder_score("widgets", "widge") == 0.90 and ma.folder_score("widgetsandmore", "widge") < 0.90 and ma.folder_score("wid", "widgets") < 0.95


DECLARED = {
    "a.swift": ("@objc public final class Alpha {\n  struct Beta<T> {\nclass func make() {}\n    override static func go(x: Int) {\nopen struct Nope\n  public @objc class Nope2\nprotocol P\nprivate enum Kind: Int {", [
        ("class", "Alpha", 1), ("struct", "Beta", 2), ("class", "func", 3), ("func", "make", 3), ("func", "go", 4), ("enum", "Kind", 8)]),
    "b.py": ("class Foo(Bar):\n  class Inner:\n    def run(self):\n    async def arun(self):\n  def odd(): pass\n        def deep(): pass\nasync def main():\ndef x(): pass", [
        ("class", "Foo", 1), ("func", "run", 3), ("func", "arun", 4), ("func", "main", 7)]),
    "c.ts": ("export abstract class Shape {\n  interface Opts {\nexport async function load() {\nfunction* gen() {}\nexport default class No {", [("class", "Shape", 1), ("interface", "Opts", 2), ("func", "load", 3)]),
    "d.kt": ("data class User(val id: Int)\n  suspend fun fetch() {\ndata sealed class No\nfun String.ext() {}", [("class", "User", 1), ("func", "fetch", 2), ("func", "String", 4)]),
    "e.go": ("type Point struct {\ntype Shape interface{\nfunc (p *Point) Move(x int) {\nfunc New() *Point {\n  func lower() {}\ntype List[T any] struct {\nfunc (Point) Bad() {}", [("struct", "Point", 1), ("interface", "Shape", 2), ("func", "Move", 3), ("func", "New", 4)]),
}


def test_declarations_of_each_language(spark):
    files = spark.createDataFrame([(p, t) for p, (t, _) in DECLARED.items()], "path string, text string")
    got = sorted(map(tuple, sy.declarations(files).collect()))
    assert got == sorted((p, *d) for p, (_, all_) in DECLARED.items() for d in all_)
    names = spark.createDataFrame([("class A1:\n  def run(self\nexport const Zed = 1\nconst q=1\nconst Yot: x\ntype Pt struct {\ntype Q = 3\nasync def no()\nexport class No\ninterface IFoo extends",)], "text string")
    assert sorted(r[0] for r in sy.symbol_names(names).collect()) == ["A1", "IFoo", "Pt", "Yot", "Zed", "run"]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"Yani, metin {i} yani", "general", "u") for i in range(20)], "id int, text string, mode string, user_id string")
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows.repartition(3).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        q = st.write_available(st.clean_stream(st.read(spark, source, rows.schema)), out, check)
        q.awaitTermination(60)
    from talkframe.operators.cleaning import clean

    assert sorted(map(tuple, spark.read.parquet(out).select("id", "text").collect())) == sorted(map(tuple, clean(rows).select("id", "text").collect()))
