"""Fill-in-middle texts against plain Python, and back."""

from __future__ import annotations

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from talkframe.llm.fill_in_middle import Recipe, fill_in_middle, op12_fill_in_middle, restored
from talkframe.llm.common import table


def plain(key: int | None, text: str | None, recipe: Recipe = Recipe()) -> tuple:
    """n, form, lengths and output by the words of the contract."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexes = hashlib.sha256(f"{recipe.seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(hexes[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    head, mid, tail = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in (recipe.prefix, recipe.suffix, recipe.middle)) or h[2] % 100 >= recipe.transformed:
        return len(units), "plain", None, None, text
    if h[3] % 100 < recipe.suffix_first:
        return len(units), "spm", len(head), len(mid), recipe.suffix + tail + recipe.prefix + head + recipe.middle + mid
    return len(units), "psm", len(head), len(mid), recipe.prefix + head + recipe.suffix + tail + recipe.middle + mid


TEXTS = [
    None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "\na\n\nb\n", "x <P> y\nz", "<S>", "<M>\n", "<p>\n<s>\n<", "S>\n<\nM>\n<\n", "über\nß\U0001f600\n \x85 no line end\r\n\tq", "one\r\ntwo\rthree\n", "nul \x00 in\nside\x00\n", "%\\n$1\n\\1\n",
    "long line " * 100_000, "".join(f"line {i}\n" for i in range(100_000)), "same\n" * 9,
]


@pytest.mark.parametrize("recipe", [Recipe(), Recipe("[p']", "[s]", "[m]", 11, 60, 20)])
def test_against_plain_python_and_back(spark, recipe):
    rows = [(i * 7 - 30, t) for i, t in enumerate(TEXTS * 4)] + [(None, "key\nis\nnull\n"), (3, "a\nb\nc"), (3, "a\nb\nc")]
    docs = spark.createDataFrame([(k, t, "kept", 1.5) for k, t in rows], "doc_id long, text string, row string, Output double")
    got = fill_in_middle(docs, recipe)
    assert got.columns == ["doc_id", "text", "row", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = got.withColumn("back", restored(F.col("output"), F.col("form"), recipe)).collect()
    assert all(r["back"] == (r["text"] or "") and r["row"] == "kept" for r in found)
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r["doc_id"], r["text"], *r[3:8]) for r in found), key=key) == sorted(((k, t, *plain(k, t, recipe)) for k, t in rows), key=key)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).collect() == []


def test_the_whole_query(spark, small):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in table(spark, small, "documents").collect():
        *row, output = plain(r["doc_id"], r["text"])
        want.append((r["doc_id"], *row, sha(output), sha(r["text"] or "")))
    assert sorted(map(tuple, op12_fill_in_middle(spark, small).collect())) == sorted(want)


def test_the_sql_is_that_of_duckdb():
    duck = duckdb.connect()
    duck.execute("CREATE TABLE t AS SELECT 0 AS place, 5 AS doc_id, 'a' || chr(10) || 'b' AS text")
    assert duck.execute(Recipe().sql("t")).fetchall()[0][1:] == plain(5, "a\nb")
