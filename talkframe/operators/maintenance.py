"""Changes to tables, as functions from the old rows to the new ones.

Parquet has no updates in place: each function gives the table that is to be written, and the
number of rows concerned where a caller is told it. ``replace`` writes it beside and swaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import first_of_each


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], order_by: Sequence[Column] = ()) -> DataFrame:
    """New rows replace old ones of the same key; of several new ones the first in ``order_by``."""
    new = first_of_each(rows, list(keys), list(order_by) or [F.lit(0)]) if order_by else rows.dropDuplicates(list(keys))
    kept = table.join(new.select(*keys), list(keys), "left_anti")
    return kept.select(table.columns).unionByName(new, allowMissingColumns=True)


def latest(changes: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """The state after a log of changes: each key's last row."""
    return first_of_each(changes, list(keys), list(order_by))


def delete(table: DataFrame, where: Column) -> DataFrame:
    """Rows that stay. A condition that is null does not delete."""
    return table.where(~F.coalesce(where, F.lit(False)))


def deleted_count(table: DataFrame, where: Column) -> DataFrame:
    return table.agg(F.count_if(F.coalesce(where, F.lit(False))).alias("deleted"))


def update(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    """``values`` take effect where the condition holds."""
    return table.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def replace_scope(table: DataFrame, rows: DataFrame, where: Column) -> DataFrame:
    """Rows of a scope are exchanged for new ones as a whole."""
    return delete(table, where).unionByName(rows, allowMissingColumns=True)


def import_once(table: DataFrame, rows: DataFrame, where: Column) -> DataFrame:
    """``rows`` are added only if no row is there yet under the condition."""
    present = table.where(where).limit(1).select(F.lit(1).alias("_there"))
    fresh = rows.join(F.broadcast(present), F.lit(True), "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True)


def add_missing(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` whose key the table lacks are added, each key once."""
    new = rows.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti")
    return table.unionByName(new.select(rows.columns), allowMissingColumns=True)


def purge(table: DataFrame, at: str, before: Column) -> DataFrame:
    """Rows that have not expired."""
    return delete(table, F.col(at) < before)


#: Tables that a user's erasure empties of the user's rows; the user is deactivated. The audit log,
#: symbols and training tables keep theirs.
ERASED = ("transcriptions", "user_dictionary", "snippets", "correction_feedback")


def erase_user(tables: dict[str, DataFrame], tenant: str, user: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the user's rows, and one row of how many each lost."""
    own = (F.col("tenant_id") == tenant) & (F.col("user_id") == user)
    left = {name: delete(df, own) if name in ERASED else df for name, df in tables.items()}
    if "users" in tables:
        gone = (F.col("tenant_id") == tenant) & (F.col("id") == user)
        left["users"] = update(tables["users"], gone, is_active=F.lit(False))
    counts = None
    for name in ERASED:
        if name in tables:
            one = deleted_count(tables[name], own).withColumnRenamed("deleted", name)
            counts = one if counts is None else counts.crossJoin(one)
    return left, counts


def append_audit(log: DataFrame, tenant: str, user: str, action: str, target: str, at: Column) -> DataFrame:
    spark = log.sparkSession
    row = spark.range(1).select(
        F.lit(tenant).alias("tenant_id"), F.lit(user).alias("user_id"), F.lit(action).alias("action"),
        F.lit(target).alias("target"), at.alias("created_at"),
    )
    return log.unionByName(row, allowMissingColumns=True)


def replace(df: DataFrame, path: str) -> None:
    """Writes ``df``, which may read from ``path``, over it: first beside it, then in its place."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    beside, old = hadoop.Path(f"{path}__new"), hadoop.Path(f"{path}__old")
    df.write.mode("overwrite").parquet(f"{path}__new")
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(beside, target)
    fs.delete(old, True)
    spark.catalog.refreshByPath(path)


#: Columns of the first symbol index; the second one has more.
FIRST_INDEX = ("user_id", "project_path", "file_path", "symbol_type", "symbol_name", "line_number")


def write_indexes(symbols: DataFrame, user: str, project: str, first: str, second: str) -> None:
    """A project's symbols take the place of its old ones in both indexes, which are Parquet folders or not there yet.

    The first index has each row once and only FIRST_INDEX; the second has all columns.
    """
    spark = symbols.sparkSession
    rows = symbols.withColumns({"user_id": F.lit(user), "project_path": F.lit(project)})
    own = (F.col("user_id") == user) & (F.col("project_path") == project)
    for path, new in ((second, rows), (first, rows.select(*FIRST_INDEX).distinct())):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        replace(replace_scope(spark.read.parquet(path), new, own) if there else new, path)
