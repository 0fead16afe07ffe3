"""Files as DataFrames: pairs in JSON lines, sentences, dictionaries, and trees of source code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import PAIR


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file fits the path, asked of Spark's own file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def json_lines(spark: SparkSession, path: str, schema: str = PAIR, required: Sequence[str] = ("input", "output")) -> DataFrame:
    """Rows of the lines that are JSON with all required fields, with file and ord, the line's order in it.

    Blank lines and bad ones are passed over; a path without files gives no rows.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumns({"file": F.lit(None).cast("string"), "ord": F.lit(None).cast("long")})
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("ord"))
    parsed = lines.where(F.trim("value") != "").withColumn("_r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    there = [F.col(f"_r.{c}").isNotNull() for c in required]
    return parsed.where(F.forall(F.array(*there), lambda x: x)).select("_r.*", "file", "ord")


def strict_json_lines(spark: SparkSession, path: str, schema: str = PAIR) -> DataFrame:
    """The same, but a bad line ends the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: trimmed lines that are not blank, as they are."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """row_id (from 0, gapless) and value of the lines that are not blank, files in the order of their names.

    A file may be split in any way: lines are numbered within their split, and the splits' counts
    are added up in the order of file and position. That table has a row a split.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    counts = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_least"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_file", "_block")) - F.col("_n")).drop("_n")
    joined = rows.join(F.broadcast(before), ["_file", "_block"])
    return joined.select((F.col("_before") + F.col("_id") - F.col("_least")).alias("row_id"), "value")


def one_field(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """row_id (the line's number) and a text field of JSON lines; a line without it is an error's row, not a gap."""
    return numbered_lines(spark, path).select("row_id", F.get_json_object("value", f"$.{field}").alias(field))


def combined(spark: SparkSession, path: str, fields: Sequence[str] = ("input", "output", "prediction")) -> DataFrame:
    """row_id and several text fields of JSON lines; a missing one is empty."""
    return numbered_lines(spark, path).select("row_id", *(F.coalesce(F.get_json_object("value", f"$.{f}"), F.lit("")).alias(f) for f in fields))


def sentences(spark: SparkSession, folder: str, longer_than: int = 10) -> DataFrame:
    """text: a sentence a line of all .txt files below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder)
    return files.select(F.trim("value").alias("text")).where(F.length("text") > longer_than)


def _colons(ddl: str) -> str:
    """Columns as a struct's fields."""
    return ",".join(":".join(c.split(maxsplit=1)) for c in ddl.split(","))


def json_array(spark: SparkSession, path: str, element: str) -> DataFrame:
    """Rows of a file that is one JSON array, with ord; ``element`` is their DDL."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", f"array<struct<{_colons(element)}>>")).alias("ord", "_r")).select("ord", "_r.*")


def source_tree(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), length and text of all files; choose with ``symbols.source_files``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.regexp_replace(F.lit(folder), "/*$", "/")
    path = F.regexp_replace(F.substring_index(F.col("path"), "://", -1), r"^file:/*", "/")
    below = F.substring(path, F.instr(path, F.regexp_replace(root, "^[a-z]+://", "")) + F.length(F.regexp_replace(root, "^[a-z]+://", "")), F.length(path))
    return files.select(below.alias("path"), "length", F.decode("content", "UTF-8").alias("text"))


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and stem of audio files, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{wav,flac,mp3}").load(folder)
    return files.select("path", "length", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"))
