"""DataFrames as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> None:
    """A JSON object a row, null fields left out; ``files`` merges small results."""
    (df.coalesce(files) if files else df).write.mode(mode).json(path)


def splits(df: DataFrame, path: str, column: str = "split") -> None:
    """A folder of JSON lines for each split."""
    df.write.mode("overwrite").partitionBy(column).json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def report(df: DataFrame, path: str) -> None:
    """A one-row report as JSON text."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)
