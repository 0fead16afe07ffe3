"""A training corpus from the documents: five stages, each one operator of ``talkframe.llm``.

``run(spark, sf_dir)`` writes every stage's result as Parquet into the shared folder (that of
``spark.checkpoint.dir``; a temporary one where it is unset on one machine) and reads it again for the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm import decontaminate, lang_id, line_dedup, packing, simhash
from talkframe.llm.common import deleted, shared_folder, table, with_columns, without

#: Cosines of unrelated vectors have a standard deviation of 1 / sqrt(1024): five times that is no chance. Texts of fewer
#: letters have too few n-grams to be told from chance, and stay.
LEAST_COSINE, LEAST_LETTERS = 0.15, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those of 80 letters or more that are like none of the learned languages.

    Null and empty texts have no letter. A null key stays; repeated rows are judged each, texts as
    a whole; a tie between languages changes nothing; an empty table gives an empty result;
    columns with other names, whatever they are, are kept. Where no text has a language, none is
    learned and all go.
    """
    del spark, sf_dir
    prototypes = lang_id.fit_prototypes(docs.select("doc_id", "text", "lang"))
    text, judged = F.col("row.text"), lang_id.identify(docs.select(F.struct("*").alias("row"), "text"), prototypes)
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    like = (F.col("score") >= LEAST_COSINE) | (letters < LEAST_LETTERS)
    return judged.where((F.col("lang_pred") != "und") & like).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but the first with them; every document stays.

    Null texts stay null, empty ones empty, and so does a text that loses all lines; n_chars,
    where there is one, is counted anew. Rows repeated under one key keep what its first document
    keeps; under a null key every recurring line with a known first document goes; of several
    first documents the smallest key counts; an empty table gives an empty result; all other
    columns are kept.
    """
    del spark, sf_dir
    into = "kept"
    while into in (c.lower() for c in docs.columns):
        into += "_"
    text = F.col(into)["text"]
    kept = line_dedup.drop_recurring_lines(docs, into=into)
    columns = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return with_columns(kept, **columns).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are similar by 0.8 or more, directly or in a chain, one stays.

    That is the one of the smallest key. Null texts, empty ones and those without a word are
    alike; rows with a null key stay; of rows repeated under the key that stays one is kept; an
    empty table gives an empty result; all columns are kept.
    """
    del spark, sf_dir
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; rows with a null key stay, whatever they hold; all rows of a
    key go if one of them holds an item; an empty table gives an empty result, an empty benchmark
    takes nothing away; all columns are kept.
    """
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return without(docs, found, "doc_id")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all tokens in windows of 2048.

    A null or empty text is its end token alone; a null key stays null; repeated rows are packed
    each; pieces of equal length come in the order of their keys; an empty table gives no row;
    all columns but key and text are ignored.
    """
    del spark, sf_dir
    import public_tokenizers

    return packing.best_fit_decreasing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("packing", packed),
]

#: Hyperdimensional vectors, fuzzy hashing and tokenizers are beyond SQL; the tests compare with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's folder goes once the next one is written; the last one's stays."""
    shared, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            deleted(spark, before)
        before = path
    return docs
