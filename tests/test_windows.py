"""Users of every seven days, phrases that texts end with, and search by postings, against plain counting."""

from __future__ import annotations

import collections
import datetime as dt
import random

from pyspark.sql import functions as F

from talkframe.operators import relational as r
from talkframe.operators import search as se


def test_users_of_every_window(spark):
    rng = random.Random(1)
    day = dt.datetime(2024, 2, 20, 23)
    rows = [(rng.choice("ab"), rng.choice([None, *(f"u{i}" for i in range(9))]), day + dt.timedelta(days=rng.choice([0, 1, 2, 3, 9, 15, 25]), hours=rng.randint(0, 2))) for _ in range(60)]
    facts = r.numbered_users(spark.createDataFrame(rows, "tenant_id string, user_id string, created_at timestamp_ntz"))
    assert {(x["user_number"] is None) == (x["user_id"] is None) for x in facts.collect()} == {True}
    want = collections.defaultdict(set)
    last = max(t.date() for _, u, t in rows if u)
    for tenant, user, t in rows:
        for i in range(7):
            if user and t.date() + dt.timedelta(days=i) <= last:
                want[tenant, t.date() + dt.timedelta(days=i)].add(user)
    got = {(x["tenant_id"], x["day"]): x["active_users"] for x in r.active_users_each_day(facts).collect()}
    assert got == {k: len(v) for k, v in want.items()}
    far = spark.createDataFrame([(1, u, day) for u in (0, 32_767, 32_768, 10**9, -1 % 2**31)], "tenant_id int, user_number long, created_at timestamp")
    assert [x["active_users"] for x in r.active_users_each_day(far, days=1).collect()] == [5]


def test_phrases_that_texts_end_with(spark):
    rows = [("a", i, f"text {i} is here thank you for watching" if i % 5 == 0 else f"quite another one {i}") for i in range(300)] + [("b", 1, "one"), ("b", 2, None), ("b", 3, ""), ("b", 4, "thank you"), ("b", 5, "thank you")]
    got = r.trailing_phrases(spark.createDataFrame(rows, "t string, i int, text string"), "t", [F.desc("i")])
    assert "GroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    found = {(x["t"], x["phrase"]): (x["n"], round(x["share"], 4)) for x in got.collect()}
    assert found["a", "for watching"] == (40, 0.2) and found["a", "here thank you for watching"] == (40, 0.2) and found["a", "quite another one"] == (160, 0.8)
    assert found["b", "thank you"] == (2, 0.5) and not any("text" in p or p.count(" ") > 4 for _, p in found)


def test_search_by_postings_opens_few_files_and_finds_all(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("abcde İé\U0001f600%_", k=rng.randint(0, 60)))) for i in range(300)] + [(900, None), (901, ""), (None, "abcabc"), (902, "ab"), (5, "again under one key: abc")]
    df = spark.createDataFrame(rows, "id long, text string")
    path = str(tmp_path / "postings")
    se.write_postings(df, path, "id")
    posted = spark.read.parquet(path)
    for query in ("abc", "AB", "a", "e\U0001f600b", "abcd", "%_", "é a", "no such text", ""):
        want = sorted(str(tuple(r)) for r in r.search(df.where("id IS NOT NULL"), F.col("text"), query).collect())
        assert sorted(str(tuple(r)) for r in se.search_postings(df, posted, "id", query).collect()) == want
    plan = se.search_postings(df, posted, "id", "abcd")
    assert "PartitionFilters: [part#" in plan._jdf.queryExecution().executedPlan().toString()
    files = posted.select(F.input_file_name().alias("f")).distinct().count()
    opened = posted.where(F.col("part").isin(*(x[0] for x in spark.createDataFrame([("abc",), ("bcd",)], "g string").select(se.part_of(F.col("g"))).collect()))).select(F.input_file_name()).distinct().count()
    assert opened * 20 < files
