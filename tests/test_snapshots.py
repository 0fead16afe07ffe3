"""Tables that change together: whole or not at all, and without writing anything again."""

from __future__ import annotations

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from talkframe.operators import snapshots as sn


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def files(root):
    return {str(p): p.stat().st_mtime_ns for p in Path(root).rglob("data/**/*.parquet")}


def test_an_erasure_rewrites_no_file(spark, tmp_path):
    root = str(tmp_path / "s")
    a = spark.createDataFrame([("t", "u", 1), ("t", "v", 2), (None, "u", 3), ("t", None, 4)], "tenant_id string, user_id string, n int")
    assert sn.change(spark, root, {"a": a, "b": a.withColumn("n", F.col("n") * 10)}) == 1
    before = files(root)
    assert sn.erase_user(spark, root, "t", "u", ("a", "b")) == 2
    assert before.items() <= files(root).items()
    assert {r["n"] for r in sn.read(spark, root, "a").collect()} == {2, 3, 4} and {r["n"] for r in sn.read(spark, root, "b").collect()} == {20, 30, 40}
    sn.change(spark, root, {"a": a.where("n = 1")})  # rows that come later stay
    assert {r["n"] for r in sn.read(spark, root, "a").collect()} == {1, 2, 3, 4}
    old = sn.read(spark, root, "a")
    sn.compact(spark, root, "a")
    entry = sn.current(spark, root)[1]["a"]
    assert len(entry["rows"]) == 1 and not entry["erased"] and {r["n"] for r in sn.read(spark, root, "a").collect()} == {1, 2, 3, 4} == {r["n"] for r in old.collect()}
    sn.change(spark, root, instead={"a": a.limit(0)})
    assert sn.read(spark, root, "a").count() == 0 and sn.read(spark, root, "b").count() == 3


def test_a_writer_that_is_killed_halfway_leaves_the_old_state(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    symbols = lambda *names: spark.createDataFrame([(f"{n}.py", "class", n, 1, "x") for n in names], "file_path string, symbol_type string, symbol_name string, line_number int, signature string")
    sn.write_indexes(symbols("A", "B"), "u", "p", root)
    sn.write_indexes(symbols("C"), "u", "q", root)
    names = lambda: [sorted(r["symbol_name"] for r in sn.read(spark, root, t).collect()) for t in ("first_index", "second_index")]
    assert names() == [["A", "B", "C"]] * 2

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(sn, "_put", killed)
        with pytest.raises(KeyboardInterrupt):
            sn.write_indexes(symbols("D"), "u", "p", root)
    assert names() == [["A", "B", "C"]] * 2
    sn.write_indexes(symbols("D", "D"), "u", "p", root)
    assert names() == [["C", "D"], ["C", "D", "D"]]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "s")
    sn.change(spark, root, {"a": spark.range(1)})
    threads = [threading.Thread(target=lambda i=i: sn.change(spark, root, {"a": spark.range(10 * i, 10 * i + 3)})) for i in range(1, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [r[0] for r in rows(sn.read(spark, root, "a"))] == sorted([0, *(10 * i + k for i in range(1, 5) for k in range(3))])
    assert sn.current(spark, root)[0] == 5


def test_only_changed_files_are_parsed_again(spark):
    from talkframe.operators import symbols as sy

    old = spark.createDataFrame([("src/a.py", "class Aaa: pass"), ("src/b/c.py", "def bbb(): pass"), ("src/b/d.py", "def ddd(): pass"), ("top.py", None)], "path string, text string")
    new = spark.createDataFrame([("src/a.py", "class Aaa: pass"), ("src/b/c.py", "def changed(): pass"), ("src/e.py", "def eee(): pass"), ("top.py", "")], "path string, text string")
    parsed = []

    def parse(files):
        parsed.append(sorted(r["path"] for r in files.collect()))
        return sy.declarations(files)

    got = sy.reindexed(new, sy.digests(old), sy.declarations(old), parse)
    assert parsed == [["src/b/c.py", "src/e.py", "top.py"]]
    assert rows(got) == rows(sy.declarations(new)) and rows(got)
    trees = [{r["folder"]: r["digest"] for r in sy.folder_digests(sy.digests(t)).collect()} for t in (old, new, old.unionAll(old.limit(0)), old.where("path <> 'top.py'"))]
    assert set(trees[0]) == {"", "src", "src/b"} and trees[0] == trees[2]
    assert all(trees[0][f] != trees[1][f] for f in trees[0]) and trees[0]["src"] == trees[3]["src"] and trees[0][""] != trees[3][""]
