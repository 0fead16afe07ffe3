"""Substring search in large tables by postings: which rows hold which three characters in a row.

Postings are written by parts, a folder each, so that a search opens the folders of its own
characters alone. Rows that have all of them are candidates and are then looked at; a query of
fewer than three characters looks at all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .relational import search

#: Characters of a gram, and parts of the postings.
GRAM, PARTS = 3, 256


def grams(text: Column) -> Column:
    """The different runs of three characters of a text in lower case; each is made once, from neighbours."""

    def runs(c: Column) -> Column:
        after = lambda n: F.slice(c, F.lit(n), F.size(c))
        pairs = F.zip_with(c, after(2), lambda a, b: F.concat(a, b))
        return F.array_distinct(F.filter(F.zip_with(pairs, after(3), lambda a, b: F.concat(a, b)), lambda g: g.isNotNull()))

    return let(F.filter(F.split(F.lower(text), ""), lambda x: x != ""), runs)


def part_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def postings(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """part, gram and the key of each row that has it; null texts have none."""
    rows = df.where(F.col(text).isNotNull()).select(F.explode(grams(F.col(text))).alias("gram"), F.col(key).alias("key"))
    return rows.select(part_of(F.col("gram")).alias("part"), "gram", "key").distinct()


def write_postings(df: DataFrame, path: str, key: str, text: str = "text") -> None:
    """The postings as Parquet, a folder a part, sorted by gram. A frequent gram is dealt over several files by its key."""
    dealt = postings(df, key, text).repartition("part", F.pmod(F.xxhash64("key"), F.lit(4)))
    dealt.sortWithinPartitions("part", "gram", "key").write.mode("overwrite").partitionBy("part").parquet(path)


def search_postings(df: DataFrame, posted: DataFrame, key: str, query: str, text: str = "text") -> DataFrame:
    """What ``search`` finds: rows whose text holds the query in any case. Rows of null keys are in no posting and are not found."""
    asked = df.sparkSession.range(1).select(grams(F.lit(query)).alias("g")).first()["g"]
    if not asked:
        return search(df.where(F.col(key).isNotNull()), F.col(text), query)
    parts = df.sparkSession.createDataFrame([(g,) for g in asked], "gram string").select(part_of(F.col("gram")).alias("p")).distinct().collect()  # of the query's own grams
    own = posted.where(F.col("part").isin(*(r["p"] for r in parts)) & F.col("gram").isin(*asked))
    hits = own.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") == len(asked)).select("key")
    return search(df.join(hits, F.col(key) == F.col("key"), "left_semi"), F.col(text), query)
