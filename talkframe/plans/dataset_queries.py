"""Training pairs on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import datasets as ds
from .registry import query
from .tables import spread, table


def pairs(spark, sf):
    return table(spark, sf, "documents").select(F.lit(0).alias("src"), F.col("doc_id").alias("ord"), F.col("lang").alias("input"), F.col("text").alias("output"))


@query("stratified_sizes", "SELECT lang, source, least(count(*), 7) AS n FROM documents GROUP BY lang, source")
def stratified_sizes(spark, sf):
    drawn = ds.stratified(table(spark, sf, "documents").select("doc_id", "lang", "source"), 7, 3, "doc_id", strata=("lang", "source"))
    return drawn.groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("dedup_first", "SELECT min(doc_id) AS ord FROM documents GROUP BY trim(text)")
def dedup_first(spark, sf):
    return ds.unique(pairs(spark, sf), ("output",), trimmed=True).select("ord")


@query("dedup_pairs", "SELECT min(doc_id) AS ord FROM documents WHERE trim(lang) <> '' AND trim(text) <> '' GROUP BY trim(lang), trim(text)")
def dedup_pairs(spark, sf):
    return ds.unique(ds.valid_pairs(pairs(spark, sf)), trimmed=True).select("ord")


@query("pair_filters", """
SELECT count(*) FILTER (role <> text) AS exact, count(*) FILTER (lower(trim(role)) <> lower(trim(text))) AS folded, count(*) FILTER (length(text) <= 1.5 * length(role)) AS short FROM conversations""")
def pair_filters(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("role").alias("input"), F.col("text").alias("output"))
    a, b, c = ds.changed(rows), ds.changed(rows, "folded"), ds.short_enough(rows)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(a, "exact").crossJoin(count(b, "folded")).crossJoin(count(c, "short"))


@query("split_sizes", """
WITH n AS (SELECT count(*) AS n FROM (SELECT DISTINCT trim(lang), trim(text) FROM documents WHERE trim(lang) <> '' AND trim(text) <> ''))
SELECT 'train' AS split, CAST(floor(n * 0.8) AS BIGINT) AS n FROM n UNION ALL SELECT 'valid', CAST(floor(n * 0.1) AS BIGINT) FROM n
UNION ALL SELECT 'test', CAST(n - floor(n * 0.8) - floor(n * 0.1) AS BIGINT) FROM n""")
def split_sizes(spark, sf):
    rows = ds.split(ds.unique(ds.valid_pairs(pairs(spark, sf)), trimmed=True), 3, "ord")
    return rows.groupBy("split").agg(F.count("*").alias("n"))


@query("split_disjoint", "SELECT count(*) AS total, count(*) AS ids, 0 AS twice FROM documents")
def split_disjoint(spark, sf):
    rows = ds.split(pairs(spark, sf), 3, "ord").groupBy("ord").agg(F.count("*").alias("n"))
    return rows.agg(F.sum("n").alias("total"), F.count("*").alias("ids"), F.count_if(F.col("n") > 1).cast("int").alias("twice"))


@query("split_with_floor", """
WITH n AS (SELECT count(*) AS n FROM benchmark), k AS (SELECT n, greatest(30, floor(n * 0.1)) AS v, greatest(20, floor(n * 0.05)) AS t FROM n)
SELECT * FROM (SELECT 'valid' AS split, CAST(least(v, n) AS BIGINT) AS n FROM k UNION ALL SELECT 'test', CAST(least(t, n - least(v, n)) AS BIGINT) FROM k
UNION ALL SELECT 'train', CAST(greatest(0, n - v - t) AS BIGINT) FROM k) WHERE n > 0""")
def split_with_floor(spark, sf):
    rows = ds.split_with_floor(table(spark, sf, "benchmark"), 3, "item_id", least=(30, 20))
    return rows.groupBy("split").agg(F.count("*").alias("n"))


@query("sample_size", "SELECT least(600, (SELECT count(*) FROM documents)) AS n, least(600, (SELECT count(*) FROM documents)) AS ids")
def sample_size(spark, sf):
    return ds.sample(pairs(spark, sf), 600, 9, "ord").agg(F.count("*").alias("n"), F.countDistinct("ord").alias("ids"))


@query("shard_rr", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) WHERE n % 3 = 1")
def shard_rr(spark, sf):
    return ds.shard(table(spark, sf, "documents").select("doc_id"), 3, 1, "doc_id")


@query("split_sorted", """
WITH n AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS n, count(*) OVER () AS t FROM customer)
SELECT c_name, CASE WHEN n < floor(t * 0.95) THEN 'train' ELSE 'eval' END AS split FROM n""")
def split_sorted(spark, sf):
    return ds.split_sorted(table(spark, sf, "customer").select("c_name"), "c_name")


@query("quota_alloc", """
WITH g AS (SELECT DISTINCT event_type FROM events)
SELECT event_type, CAST(1003 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY event_type) <= 1003 % count(*) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM g""")
def quota_alloc(spark, sf):
    return ds.quotas(table(spark, sf, "events").select("event_type").distinct(), 1003, "event_type")


@query("composite_counts", "SELECT role || ':' || turn % 3 AS key, count(*) AS n FROM conversations GROUP BY 1")
def composite_counts(spark, sf):
    return ds.composite_counts(table(spark, sf, "conversations").withColumn("m", (F.col("turn") % 3).cast("string")), "role", "m")


@query("quality_counters", """
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (lang IS NULL OR text IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (trim(lang) = '' OR trim(text) = '') AS BIGINT) AS empty,
       CAST(count(*) FILTER (lang <> text) AS BIGINT) AS changed, CAST(count(*) - count(DISTINCT (lang, text)) AS BIGINT) AS duplicates FROM documents""")
def quality_counters(spark, sf):
    return ds.quality(pairs(spark, sf))


@query("chat_format", """
SELECT '<|im_start|>system' || chr(10) || 'Fix it.' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || role || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || text || '<|im_end|>' AS text, conv_id, turn FROM conversations""")
def chat_format(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("input"), F.col("text").alias("output"))
    return ds.chat_rows(rows, "Fix it.")


@query("corrupt_punct", "SELECT item_id, regexp_replace(text, '[.,!?;:]', '', 'g') AS text FROM benchmark")
def corrupt_punct(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tx.drop_punctuation(F.col("text")).alias("text"))


@query("corrupt_fold", f"SELECT item_id, translate(text, '{tx.MARKED}', '{tx.PLAIN}') AS text FROM benchmark")
def corrupt_fold(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tx.fold_marks(F.col("text")).alias("text"))


VARIANTS = {"the": ("da", "zo"), "of": ("ov",)}


@query("corrupt_persona")
def corrupt_persona(spark, sf):
    rows = spread(table(spark, sf, "benchmark")).select(F.col("item_id").alias("id"), "text", F.element_at(F.array(*map(F.lit, ds.STYLES)), (F.col("item_id") % 4 + 1).cast("int")).alias("persona"))
    return ds.persona_variants(rows, VARIANTS, 42)


@query("corrupt_difficulty")
def corrupt_difficulty(spark, sf):
    return ds.spoilt_pairs(spread(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")), 42)


@query("corrupt_round")
def corrupt_round(spark, sf):
    return ds.spoilt_round(spread(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")), 5, "low", 42)


@query("template_pairs", """
WITH p AS (SELECT DISTINCT 'Open ' || n_name || ' now.' AS output FROM nation UNION SELECT DISTINCT 'Where is ' || n_name || '?' FROM nation)
SELECT lower(rtrim(output, '.?')) AS input, output FROM p""")
def template_pairs(spark, sf):
    templates = spark.createDataFrame([("open {class} now",), ("where is {class}?",)], "template string")
    return ds.from_templates(templates, table(spark, sf, "nation").select(F.col("n_name").alias("word")), "class")


@query("recognition_pairs", r"""
WITH t AS (SELECT text AS heard, upper(substr(trim(text), 1, 1)) || substr(regexp_replace(trim(text), '\s+', ' ', 'g'), 2) AS truth FROM benchmark)
SELECT heard AS input, CASE WHEN right(truth, 1) IN ('.', '!', '?', '…') THEN truth ELSE truth || '.' END AS output FROM t
WHERE lower(trim(heard)) <> lower(CASE WHEN right(truth, 1) IN ('.', '!', '?', '…') THEN truth ELSE truth || '.' END)""")
def recognition_pairs(spark, sf):
    rows = table(spark, sf, "benchmark")
    return ds.recognition_pairs(rows.select(F.col("text").alias("heard"), F.col("text").alias("truth")))


@query("pair_by_stem", """
SELECT c_name AS stem, CASE WHEN c_custkey % 2 = 0 THEN 'own' ELSE 'line ' || c_custkey || ', b' END AS text FROM customer""")
def pair_by_stem(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("stem"))
    own = rows.where("c_custkey % 2 = 0").select("stem", F.lit("own").alias("text"))
    line = lambda file, n, said: rows.select(F.lit(file).alias("file"), n.alias("line_no"), F.concat(F.lit("x y."), "stem", F.lit(".wav"), said).alias("line"))
    key = F.col("c_custkey")
    lines = line("b.csv", key, F.concat(F.lit("|line "), key.cast("string"), F.lit(", b"))).unionAll(line("a.csv", key, F.lit("\tno")))
    return ds.pair_by_stem(rows.select("stem", F.col("stem").alias("path")), own, lines.unionAll(line("b.csv", key + 1_000_000, F.lit(",late")))).select("stem", "text")


@query("resume_remaining", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark, sf):
    return ds.remaining(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("merge_sources", "SELECT 0 AS src, count(*) AS n FROM nation UNION ALL SELECT 1, count(*) FROM region")
def merge_sources(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_name").alias("input"))
    b = table(spark, sf, "region").select(F.col("r_name").alias("input"), F.lit("x").alias("output"))
    return ds.merge(a, b).groupBy("src").agg(F.count("*").alias("n"))
