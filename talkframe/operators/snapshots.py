"""Several Parquet tables that change together, in one step that is taken as a whole or not at all.

A folder holds numbered snapshots, each a small file that lists the tables' folders. A change
writes new folders beside the old ones, rows to add and keys to erase, and then puts the next
number in place; who finds that number taken tries the one after. Nothing that was written is
written again: an erasure is a folder of keys, which readers leave out by a join. ``compact``
writes a table anew without what was erased.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .maintenance import FIRST_INDEX

#: How often a change is tried again where others were quicker.
TRIES = 100


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> tuple[int, dict[str, dict]]:
    """The last snapshot's number and tables; 0 and none where there is none yet."""
    path, fs = _files(spark, root)
    if not fs.exists(path(root)):
        return 0, {}
    names = [s.getPath().getName() for s in fs.listStatus(path(root))]
    numbers = sorted(int(n[9:-5]) for n in names if n.startswith("snapshot-") and n.endswith(".json"))
    if not numbers:
        return 0, {}
    return numbers[-1], json.loads(spark.read.text(f"{root}/snapshot-{numbers[-1]:09d}.json", wholetext=True).first()[0])


def _put(spark: SparkSession, root: str, number: int, tables: dict[str, dict]) -> bool:
    """Whether the snapshot took its place; not where the number is taken."""
    path, fs = _files(spark, root)
    beside, there = path(f"{root}/_{uuid.uuid4().hex}"), path(f"{root}/snapshot-{number:09d}.json")
    out = fs.create(beside)
    out.write(bytearray(json.dumps(tables).encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(root).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(beside, there, spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        fs.delete(beside, False)
        return False
    return True


def change(spark: SparkSession, root: str, add: Mapping[str, DataFrame] | None = None, erase: Mapping[str, DataFrame] | None = None, instead: Mapping[str, DataFrame] | None = None) -> int:
    """One step: rows with the keys in ``erase`` go, rows in ``add`` come; tables in ``instead`` are exchanged as a whole. The snapshot's number.

    Keys are equal in all columns that ``erase`` has; a null key erases nothing. Rows that come in the same step stay.
    """

    def written(df: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{root}/{folder}")
        return folder

    added, gone, new = ({name: written(df) for name, df in (part or {}).items()} for part in (add, erase, instead))
    columns = {name: df.columns for name, df in (erase or {}).items()}
    for _ in range(TRIES):
        last, tables = current(spark, root)
        number = last + 1
        for name, folder in new.items():
            tables[name] = {"rows": [[folder, number]], "erased": []}
        for name, folder in added.items():
            tables.setdefault(name, {"rows": [], "erased": []})["rows"].append([folder, number])
        for name, folder in gone.items():
            tables.setdefault(name, {"rows": [], "erased": []})["erased"].append([folder, number, columns[name]])
        if _put(spark, root, number, tables):
            return number
    raise RuntimeError(f"{root} is changed by others all the time")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as of the last snapshot. A later change does not alter what was read."""
    entry = current(spark, root)[1][name]
    parts = []
    for number in sorted({n for _, n in entry["rows"]}):
        part = spark.read.parquet(*(f"{root}/{f}" for f, n in entry["rows"] if n == number))
        for folder, at, columns in entry["erased"]:
            if at > number:
                part = part.join(spark.read.parquet(f"{root}/{folder}"), columns, "left_anti").select(part.columns)
        parts.append(part)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def compact(spark: SparkSession, root: str, name: str) -> int:
    """The table in one folder, without what was erased. Meant for when no one else changes it: what others add meanwhile would be lost, so it fails then."""
    last, _ = current(spark, root)
    folder = f"data/{uuid.uuid4().hex}"
    read(spark, root, name).write.parquet(f"{root}/{folder}")
    now, tables = current(spark, root)
    tables[name] = {"rows": [[folder, last + 1]], "erased": []}
    if now != last or not _put(spark, root, last + 1, tables):
        raise RuntimeError(f"{root} was changed meanwhile")
    return last + 1


def write_indexes(symbols: DataFrame, user: str, project: str, root: str) -> int:
    """A project's symbols take the place of its old ones in both indexes at once; other projects' files stay as they are.

    ``first_index`` has each row once and only FIRST_INDEX; ``second_index`` has all columns.
    """
    spark = symbols.sparkSession
    rows = symbols.withColumns({"user_id": F.lit(user), "project_path": F.lit(project)})
    scope = spark.range(1).select(F.lit(user).alias("user_id"), F.lit(project).alias("project_path"))
    return change(spark, root, {"first_index": rows.select(*FIRST_INDEX).distinct(), "second_index": rows}, {"first_index": scope, "second_index": scope})


def erase_user(spark: SparkSession, root: str, tenant: str, user: str, names: tuple[str, ...]) -> int:
    """A user's rows go from all these tables in one step, and no data file is written again."""
    key = spark.range(1).select(F.lit(tenant).alias("tenant_id"), F.lit(user).alias("user_id"))
    return change(spark, root, erase={n: key for n in names})
