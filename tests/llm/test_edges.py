"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from talkframe.llm import decontaminate, lang_id, line_dedup, packing, secret_scan, sharding, simhash, topk, toxicity, url_filter

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "s"),
    (2, None, None, None), (3, "", "en", "s"), (4, " \n\t ", "fr", "s"), (5, LONG, "en", "s"), (6, "12345 !!! ...", "de", None),
    (7, "Le renard brun saute par dessus le chien paresseux encore.", "fr", "s"), (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "s"),
    (8, "İSTANBUL ﬁne ß \u0000 \U0001f600 a\u0301", "xx", "s"), (None, "key is null here", "en", "s"),
]
DDL = "doc_id long, text string, lang string, source string"
#: Names that operators use for their results or inside.
CLASHES = (
    "shard", "slot", "score", "lang_pred", "predicted", "_h", "_g", "_n", "_bin", "_part", "_bits", "_rank", "_first", "_shard", "_size", "_kept", "_raw", "_key", "_text", "_judged", "fp",
    "node", "group_id", "start", "Score", "size", "row", "judged", "key", "raw", "drop", "of", "c0", "kept", "first", "n", "g", "_best", "_label", "_half", "host", "path", "rule", "verdict", "keys",
)
#: Result columns that replace the input's, and operators that pass on all others.
REPLACED = {
    "shard": {"shard", "slot"}, "language": {"lang_pred", "score"}, "one": set(), "lines": {"_kept"}, "redact": set(), "toxicity": {"score", "predicted"},
    "urls": {"host", "path", "rule", "verdict"},
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DDL)


@pytest.fixture(scope="module")
def model():
    return toxicity.Model({"idiot": 3.0}, {"moro": 2.0}, [-3.0, 4.0, 0.0, 0.0, 0.0, 0.0])


@pytest.fixture(scope="module")
def prototypes(docs):
    return lang_id.fit_prototypes(docs)


def tokenizer() -> str:
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def operators(spark, model, prototypes):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "one two")], "item_id long, text string")
    rules = spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")
    return {
        "shard": lambda d: sharding.histogram_sort(d, 4),
        "language": lambda d: lang_id.identify(d, prototypes),
        "fingerprints": simhash.fingerprint_components,
        "near": simhash.near_duplicates,
        "one": simhash.keep_one,
        "contaminated": lambda d: decontaminate.contaminated(d, bench),
        "lines": line_dedup.drop_recurring_lines,
        "secrets": secret_scan.scan,
        "redact": secret_scan.redact,
        "pack": lambda d: packing.best_fit_decreasing(d, tokenizer(), 64),
        "toxicity": lambda d: toxicity.score(d, model),
        "urls": lambda d: url_filter.filter_urls(d.withColumn("url", F.col("text")), rules),
    }


NAMES = ("shard", "language", "fingerprints", "near", "one", "contaminated", "lines", "secrets", "redact", "pack", "toxicity", "urls")


#: Operators that give a row for every row, and those that give one for each that has a key.
EVERY, KEYED = ("shard", "language", "fingerprints", "lines", "secrets", "redact", "toxicity", "urls"), ("near",)


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(docs, operators, name):
    got = [r["doc_id"] for r in operators[name](docs).collect()]
    order = lambda ids: sorted(ids, key=str)
    keys = [r[0] for r in ROWS]
    if name in EVERY:
        assert order(got) == order(keys)
    elif name in KEYED:
        assert order(got) == order(k for k in keys if k is not None)
    else:
        assert got and set(got) <= set(keys)
        assert name != "pack" or set(got) == set(keys)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, operators, name):
    assert operators[name](spark.createDataFrame([], DDL)).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns(docs, operators, name):
    crowded = docs.where("doc_id < 8")
    for c in CLASHES:
        if c.lower() not in {x.lower() for x in crowded.columns}:
            crowded = crowded.withColumn(c, F.lit("mine"))
    out = operators[name](crowded)
    rows = out.collect()
    assert rows
    if name in REPLACED:  # every other column is there, with its values
        kept = [c for c in crowded.columns if c.lower() not in REPLACED[name] and c not in ("text", "source", "lang", "doc_id")]
        assert set(kept) <= set(out.columns) and all(r[c] == "mine" for r in rows for c in kept)
        own = {(r["doc_id"], r["lang"], r["source"]) for r in crowded.collect()}
        assert {(r["doc_id"], r["lang"], r["source"]) for r in rows} <= own


def test_clashes_in_training_and_search(spark, docs):
    crowded = docs.where("doc_id < 8").withColumns({c: F.lit("mine") for c in ("key", "_label", "_half", "_text", "_lang", "share", "label", "n", "q_id", "floor")})
    labels = crowded.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), "label", "_label", "key", "text")
    assert set(lang_id.fit_prototypes(crowded)) == {"en", "fr"}
    assert isinstance(toxicity.fit(crowded, labels), toxicity.Model)
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, vector array<double>")
    v = v.withColumns({c: F.lit("mine") for c in ("qb", "db", "floor", "q_id", "q_vector", "rank", "score", "query_id", "part")})
    assert topk.top_k(v.where("vec_id < 2"), v, 2).count() == 4


def by_id(df, column):
    return {r["doc_id"]: r[column] for r in df.collect()}


def test_defined_results(spark, docs, operators):
    shards = operators["shard"](docs)
    assert shards.count() == len(ROWS)
    for _, rows in shards.toPandas().groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    lang = by_id(operators["language"](docs), "lang_pred")
    assert lang[1] == "en" and lang[2] == lang[3] == lang[4] == lang[6] == "und"
    fps = by_id(operators["fingerprints"](docs), "fp")
    assert fps[2] == fps[3] == fps[4] == 0 and by_id(operators["fingerprints"](docs), "component_id")[4] == 2
    near = by_id(operators["near"](docs), "group_id")
    assert None not in near and near[3] == near[4] == 2
    kept = operators["one"](docs).select("doc_id").collect()
    assert sorted(r[0] for r in kept if r[0] is not None) == [1, 2, 5, 6, 7, 8] and sum(r[0] is None for r in kept) == 1
    found = operators["contaminated"](docs).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(1, 1), (1, 1)]
    lines = by_id(operators["lines"](docs), "_kept")
    assert lines[2]["text"] is None and lines[3]["text"] == "" and lines[5]["text"] == LONG
    pack = operators["pack"](docs).toPandas()
    for _, rows in pack.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert list(rows.offset) == list(rows.length.cumsum() - rows.length) and rows.length.sum() <= 64
    assert pack[pack.doc_id == 2].length.tolist() == [1] and (pack.doc_id == 1).sum() == 2
    scores = by_id(operators["toxicity"](docs), "score")
    assert scores[2] == scores[3] and 0 <= scores[2] <= 1
    urls = operators["urls"](docs).first()
    assert (urls["host"], urls["path"], urls["rule"], urls["verdict"]) == ("", "", None, "allow")


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (50, [0.5, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [-0.001, 0.0]), (1, [1.0, 0.5])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.quantized(F.col("embedding")).alias("vector")).where("vector is not null")
    got = sorted(map(tuple, topk.top_k(v.where("vec_id % 50 = 0"), v, 3).collect()))
    assert got == [(0, 1, 1, 81920), (0, 2, 2, 81920), (0, 3, 50, 49152), (50, 1, 0, 49152), (50, 2, 1, 49152), (50, 3, 2, 49152)]
    assert topk.top_k(v.where("false"), v).count() == 0 and topk.top_k(v, v.where("false")).count() == 0


def test_pipeline_on_odd_rows(spark, docs, tmp_path):
    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of the kind is in here at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    tokenizer()
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id.dropna()) <= {1, 5, 7, 8} and {1, 5, 7} <= set(out.doc_id.dropna())


STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stage_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    items = [(1, "an item that one of the documents holds as a whole from its first word to its last"), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def crowd(spark, stage_dir, *names: str):
    """Documents with repeated rows, ties, odd texts, one that holds an item, and columns of these names."""
    item = spark.read.parquet(f"{stage_dir}/benchmark.parquet").where("item_id = 1").first()["text"]
    line = "This line of six words and more recurs in many of the documents"
    said = [f"{line}\nThe quick brown fox number {w} jumps over the lazy dog and runs away" for w in ("alpha", "beta", "gamma", "delta")]
    rows = [(i, t, "en", "s") for i, t in enumerate(said)] + [(0, said[0], "en", "s"), (10, said[1], "en", "s"), (11, f"Some words before. {item}. And after it.", "en", "s"), *ROWS]
    df = spark.createDataFrame(rows, DDL).withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({n: F.concat(F.lit("mine "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})


@pytest.mark.parametrize("name", [n for n in STAGES if n != "packing"])
def test_stages_keep_all_columns_and_say_the_same_beside_them(spark, stage_dir, name):
    plain, crowded = crowd(spark, stage_dir), crowd(spark, stage_dir, *(c for c in dict.fromkeys(c.lower() for c in (*CLASHES, "kept_", "kept__", "into", "lead", "crowd", "sim")) if c not in ("text", "lang", "source", "doc_id")))
    got = STAGES[name](spark, crowded, stage_dir)
    assert got.columns == crowded.columns
    rows = got.collect()
    assert rows and all(r[c] == f"mine {'-' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in crowded.columns if c not in plain.columns)
    short = lambda r: str((r["doc_id"], hash(r["text"]), r["lang"], r["n_chars"]))
    assert sorted(map(short, rows)) == sorted(map(short, STAGES[name](spark, plain, stage_dir).collect()))
    ids = [r["doc_id"] for r in rows]
    if name == "lines":
        assert len(ids) == plain.count() and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    if name == "near_duplicates":
        assert 10 not in ids and ids.count(0) == 1 and ids.count(None) == 1 and len(ids) == len(set(ids))
    if name == "benchmark":
        assert 11 not in ids and len(ids) == plain.count() - 1
    if name == "language":
        assert all(any(c.isalpha() for c in r["text"] or "") for r in rows) and {0, 1, 2, 3, 10, 11} <= set(ids) and not {4, 6} & set(ids)


def test_packing_ignores_other_columns(spark, stage_dir):
    tokenizer()
    crowded = crowd(spark, stage_dir, "start", "length", "sequence_id", "offset", "ids", "tokens", "key", "row", "piece")
    same = [sorted(map(str, STAGES["packing"](spark, d, stage_dir).collect())) for d in (crowded, crowd(spark, stage_dir))]
    assert same[0] == same[1] and same[0]


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_of_empty_tables(spark, stage_dir, name):
    tokenizer()
    assert STAGES[name](spark, crowd(spark, stage_dir, "kept", "_kept").limit(0), stage_dir).collect() == []
