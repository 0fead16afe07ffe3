"""Samples of strata, the recipes of training sets, tags, and limits on streams."""

from __future__ import annotations

import collections
import datetime as dt

from pyspark.sql import functions as F

from talkframe.operators import datasets as ds
from talkframe.streaming import transcripts as st


def pairs(spark, n, tag):
    return spark.createDataFrame([(f"{tag} in {i}", f"{tag} out {i}", i) for i in range(n)], "input string, output string, ord int")


def sizes(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


def test_samples_of_strata_are_the_first_of_a_shuffle(spark, monkeypatch):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("s"), F.when(F.col("id") % 2 == 0, "x").alias("t"))
    rows = rows.unionAll(rows.where("id < 30"))
    for bits in (16, 3, 1):
        monkeypatch.setattr(ds, "BIN_BITS", bits)
        got = collections.defaultdict(list)
        for r in ds.stratified(rows.repartition(5), 40, 9, "id", strata=("s", "t")).collect():
            got[r["s"], r["t"]].append(r["id"])
        order = {r["id"]: r["_h"] for r in rows.select("id", ds.order(9, F.col("id")).alias("_h")).collect()}
        all_ = collections.defaultdict(list)
        for r in rows.collect():
            all_[r["s"], r["t"]].append(r["id"])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(sorted(v, key=lambda i: (order[i], i))[:40]) for k, v in all_.items()}
        assert sorted(r["id"] for r in ds.sample(rows, 100, 9, "id").collect()) == sorted(sorted(sum(all_.values(), []), key=lambda i: (order[i], i))[:100])
    assert ds.sample(rows.where("id < 3"), 100, 9, "id").count() == 6 and ds.sample(rows.limit(0), 5, 9, "id").count() == 0 and ds.sample(rows, 0, 9, "id").count() == 0


def test_a_refreshed_set_holds_all_new_and_some_old_pairs(spark):
    new, old = pairs(spark, 500, "new"), pairs(spark, 900, "old")
    out = ds.refresh(new, old, 4)
    assert sizes(out) == {"train": 1100 - 110 - 55, "valid": 110, "test": 55}
    kinds = {r["k"]: r["n"] for r in out.groupBy(F.split_part("input", F.lit(" "), F.lit(1)).alias("k")).agg(F.countDistinct("input").alias("n")).collect()}
    assert kinds == {"new": 500, "old": 600}
    small = ds.refresh(pairs(spark, 60, "new"), pairs(spark, 5, "old"), 4)
    assert sizes(small) == {"train": 15, "valid": 30, "test": 20}


def test_an_extended_set_keeps_the_prior_split(spark):
    prior = pairs(spark, 20, "prior").withColumn("split", F.when(F.col("ord") < 12, "train").when(F.col("ord") < 17, "valid").otherwise("test"))
    out = ds.extend(pairs(spark, 100, "new"), prior, 1)
    assert sizes(out) == {"train": 12 + 85, "valid": 5 + 10, "test": 3 + 5}
    assert {tuple(r) for r in prior.select("input", "split").collect()} <= {tuple(r) for r in out.select("input", "split").collect()}
    assert sizes(ds.extend(pairs(spark, 3, "new"), prior, 1)) == {"train": 13, "valid": 6, "test": 4}


def test_rounds_add_up_and_an_input_counts_once(spark):
    files = pairs(spark, 30, "r").withColumn("round", F.col("ord") % 3 + 1).unionByName(pairs(spark, 10, "r").withColumns({"round": F.lit(2), "output": F.lit("later")}))
    base = [pairs(spark, 5, "base"), pairs(spark, 3, "r").withColumn("output", F.lit("first"))]
    for last, n in ((1, 10 + 5 + 2), (2, 20 + 5 + 1 + 3), (3, 35)):
        out = ds.rounds(files, last, base, 2)
        inputs = [r["input"] for r in out.collect()]
        want = {r["input"] for b in base for r in b.collect()} | {r["input"] for r in files.where(F.col("round") <= last).collect()}
        assert sorted(inputs) == sorted(want) and (last < 3 or len(inputs) == n)
    assert {r["output"] for r in out.where(F.col("input").isin("r in 0", "r in 1", "r in 2")).collect()} == {"first"}
    train = sizes(out)
    assert train == {"train": 28, "valid": 3, "test": 4}


def test_tags(spark):
    out = ds.tagged(pairs(spark, 2, "x"), type="filler", difficulty="hard").collect()
    assert [(r["type"], r["difficulty"]) for r in out] == [("filler", "hard")] * 2


def test_requests_a_minute(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 5, 1, 10) + dt.timedelta(seconds=s)
    rows = [("a", at(1)), ("a", at(59)), ("a", at(60)), ("b", at(30)), (None, at(5)), ("a", at(4000))]
    spark.createDataFrame(rows, "user_id string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = st.read(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    q = st.write_available(st.per_minute(source).select("window.start", "user_id", "n"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(90)
    got = {(r["user_id"], (r["start"] - dt.datetime(2024, 5, 1, 10)).total_seconds()): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 0): 2, ("a", 60): 1, ("b", 0): 1, (None, 0): 1}  # the last minute is still open


def test_limits_hold_over_restarts_late_and_repeated_rows(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 5, 1, 10) + dt.timedelta(seconds=s)
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "request_id long, user_id string, ts timestamp"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        read = st.read(spark, source, spark.read.parquet(source).schema)
        st.write_available(st.limited(read, 2), out, check).awaitTermination(120)
        return {r["request_id"]: r["allowed"] for r in spark.read.parquet(out).collect()}

    assert run([(1, "a", at(1)), (2, "a", at(50)), (2, "a", at(50)), (3, "b", at(5)), (4, "a", at(61))]) == {1: True, 2: True, 3: True, 4: True}
    # A new run: a third request of the first minute, one that was there before, a second user's.
    assert run([(5, "a", at(30)), (1, "a", at(1)), (6, "b", at(6)), (7, None, at(6))]) == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True}
    run([(8, "a", at(4000))])
    got = run([(9, "a", at(40)), (10, "a", at(3990)), (11, "a", at(4001))])  # the first is too late
    assert got == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True, 8: True, 10: True, 11: False}
    assert spark.read.parquet(out).count() == 10
