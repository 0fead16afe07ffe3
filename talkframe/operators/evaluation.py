"""Evaluation of corrections: error rates, exact matches, and whether retractions were resolved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edits import counted_edits
from ..functions.text import contains_any, strip, word_count

#: Words by which a speaker takes something back.
RETRACTIONS = (
    "hayır yok yok", "dur bir dakika", "aslında", "pardon", "scratch that", "actually", "wait", "i mean", "no wait", "let me rephrase",
)


def cer(reference: Column, answer: Column) -> Column:
    """Edits by the reference's length, both stripped; an empty reference gives 0 or 1."""
    r, a = strip(reference), strip(answer)
    return F.when(F.length(r) == 0, F.when(F.length(a) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(r, a) / F.length(r))


def exact(reference: Column, answer: Column) -> Column:
    return F.lower(strip(reference)) == F.lower(strip(answer))


def unresolved(source: Column, answer: Column, markers: Sequence[str] = RETRACTIONS) -> Column:
    """Null if the source retracts nothing; else whether a retraction is still in the answer."""
    return F.when(contains_any(source, markers), contains_any(answer, markers))


def details(rows: DataFrame, source: str = "input", reference: str = "output", answer: str = "prediction", most: int = 120) -> DataFrame:
    """Rows with cer, exact, and their texts cut for reading."""
    r, a = F.col(reference), F.col(answer)
    return rows.withColumns({"cer": F.round(cer(r, a), 4), "exact": exact(r, a), "reference_cut": F.substring(r, 1, most), "answer_cut": F.substring(a, 1, most)})


def report(rows: DataFrame, source: str = "input", reference: str = "output", answer: str = "prediction") -> DataFrame:
    """One row: samples, wer (edits by words over all), its substitutions, insertions and deletions, cer (mean), exact_match and backtracking in percent.

    A rate without rows to judge is null. Everything is a sum or a mean, formed in parallel.
    """
    r, a = F.col(reference), F.col(answer)
    edits = counted_edits(r, a, by_words=True)
    left = unresolved(F.col(source), a) if source in rows.columns else F.lit(None).cast("boolean")
    judged = rows.select(edits.alias("e"), word_count(r).alias("n"), cer(r, a).alias("c"), exact(r, a).alias("x"), left.alias("l"))
    kinds = ("substitutions", "insertions", "deletions")
    return judged.agg(
        F.count("*").alias("samples"),
        F.round(F.sum(sum((F.col(f"e.{k}") for k in kinds), F.lit(0))) / F.nullif(F.sum("n"), F.lit(0)), 4).alias("wer"),
        *(F.sum(f"e.{k}").alias(k) for k in kinds),
        F.round(F.avg("c"), 4).alias("cer"),
        F.round(F.avg(F.col("x").cast("int")) * 100, 2).alias("exact_match"),
        F.round(F.avg((~F.col("l")).cast("int")) * 100, 2).alias("backtracking"),
    )


def paired(references: DataFrame, answers: DataFrame, key: str = "row_id") -> DataFrame:
    """References and answers by their row's number; a row that one side lacks is an error."""
    both = references.join(answers, key, "full")
    gap = F.col(references.columns[-1]).isNull() | F.col(answers.columns[-1]).isNull()
    return both.where(F.when(gap, F.raise_error(F.concat(F.lit("no partner for row "), F.col(key).cast("string")))).otherwise(F.lit(True)).cast("boolean"))
