"""Jobs that must grow with their input, and results that contracts fix."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from talkframe.functions import edits
from talkframe.operators import datasets as ds


def test_op1_follows_its_contract(spark, tmp_path):
    from talkframe.llm.url_filter import op1_url_filter

    urls = ["http://a.example.org/en/1", "http://example.org/en/2", "http://example.org/es/1", "http://x.com/fr/1", "http://x.com/de/1"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in op1_url_filter(spark, str(tmp_path)).collect()}
    assert got == {0: ("example.org/en/1", "block"), 1: ("org/", "allow"), 2: ("example.org/es/", "block"), 3: ("com/fr/", "allow"), 4: ("com/de/", "block")}


def test_certain_edits_are_the_searched_ones(monkeypatch):
    rng = random.Random(3)
    for _ in range(400):
        a = "".join(rng.choices("abAB,", k=rng.randrange(30)))
        b = "".join(x.lower() for x in a if x != "," or rng.random() < 0.1)
        b = b if rng.random() < 0.7 else b[: len(b) // 2] + rng.choice("abA") + b[len(b) // 2 :]
        for x, y in ((a, b), (b, a)):
            certain = edits._certain_counts(x, y)
            with monkeypatch.context() as m:
                m.setattr(edits, "_certain_counts", lambda *_: None)
                assert certain in (None, edits.edit_counts(x, y))


def test_edits_of_a_long_text_take_no_search():
    rng = random.Random(4)
    a = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ABC.,", k=300_000))
    b = a.translate(str.maketrans("ABC", "abc", ".,"))
    start = time.time()
    capitals, marks = sum(a.count(x) for x in "ABC"), sum(a.count(x) for x in ".,")
    assert edits.edit_counts(a, b) == (capitals, 0, marks) and edits.edit_counts(b, a) == (capitals, marks, 0)
    assert time.time() - start < 20


def test_stems_of_equal_beginnings_do_not_meet(spark):
    n = 20_000
    audio = spark.range(n).select(F.format_string("Customer#%09d", "id").alias("stem"), F.lit("p").alias("path"))
    lines = spark.range(n).select(F.lit("a.csv").alias("file"), F.col("id").alias("line_no"), F.concat(F.lit("x y."), F.format_string("Customer#%09d", "id"), F.lit(".wav|line "), F.col("id").cast("string")).alias("line"))
    start = time.time()
    got = ds.pair_by_stem(audio, spark.createDataFrame([], "stem string, text string"), lines)
    assert got.where(F.col("text") == F.concat(F.lit("line "), F.regexp_extract("stem", "#0*([0-9]+)", 1).cast("long").cast("string"))).count() == n
    assert time.time() - start < 30


def test_texts_become_values_in_bounded_slices():
    import pyarrow as pa

    from talkframe.operators import lexicons as lx

    batch = pa.RecordBatch.from_pydict({"t": ["x" * 1000] * 10_000, "n": list(range(10_000))})
    parts = list(lx.in_slices(batch))
    assert pa.Table.from_batches(parts).combine_chunks().to_batches()[0].equals(batch)
    assert max(p.num_rows for p in parts) <= lx.BYTES_AT_ONCE // 1000
    out = list(lx.in_batches((("y" * 5000, 1) for _ in range(2000)), pa.schema([("t", pa.string()), ("n", pa.int32())])))
    assert sum(b.num_rows for b in out) == 2000 and max(b.nbytes for b in out) < 2 * lx.BATCH_BYTES


def test_clean_chain_leaves_recognised_loops(spark, tmp_path):
    from talkframe.plans import QUERIES

    said = "Ab cd. of of of of of\nand more"
    spark.createDataFrame([(1, 1, "user", said)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    row = QUERIES["clean_chain"](spark, str(tmp_path)).first()
    assert (row["text"], row["was_corrected"]) == (said, False)


def test_rounds_of_components_are_few_stages(spark):
    from talkframe.llm.graph import components

    chain = spark.range(64).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    spark.sparkContext.setJobGroup("few stages", "")
    try:
        assert components(chain).where("root = 0").count() == 65
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few stages")) < 40
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def agrees_over(spark, path, name, *texts):
    """The query agrees with its SQL over a conversation of these texts."""
    import duckdb

    from talkframe.plans import ORACLE_SQL, QUERIES

    from .compare import assert_same

    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    assert_same(QUERIES[name](spark, str(path)), duck, ORACLE_SQL[name])


def test_texts_with_fillers_of_their_own_stay(spark, tmp_path):
    texts = "Aa of aa, hmm. Ee\nin.", "Of aa\ua7f8 Şey aa.", "Aaa", "Of it.", "Aaront ehm.", None
    agrees_over(spark, tmp_path, "filler_clean", *texts)


def test_words_like_symbols_stay(spark, tmp_path):
    agrees_over(spark, tmp_path, "symbol_inject", "Reoring of a.\nReoringes Reoring, in Aute.", "Astall Of it.", "Of Patrevi.", "Of it.")
