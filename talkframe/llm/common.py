"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path may be one that only Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named in ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is chosen, but only on one machine, as in tests; on a
    cluster the executors would not see it, and this is an error.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="talkframe-")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut through the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def deleted(spark: SparkSession, path: str) -> None:
    """A folder that is needed no more goes, in whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch, but for one row that is larger. An executor's JVM and Python hold a batch a few times each.
BYTES_AT_ONCE = 2 << 20


def lean(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded by their bytes.

    Plans are lazy, so the setting has to hold when the result is used: all operators set it to
    the same value, and it is left in place.
    """
    df.sparkSession.conf.set(BATCH_BYTES, BYTES_AT_ONCE)
    return df


def _give_back() -> None:
    """Memory that Arrow and the C library hold free goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a partition's batches, after which the worker gives its memory back: workers outlive tasks."""

    def kept(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return kept


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def bytes_of(name: str = "text") -> Column:
    """UTF-8 bytes of a text; a null text has none."""
    return F.coalesce(F.octet_length(F.col(name)), F.lit(0)).cast("long")


#: Keys that are broadcast at most; more are joined by an exchange.
MOST_KEYS = 1_000_000


def hinted(keys: DataFrame) -> DataFrame:
    """``keys``, a table that is quick to read, to be broadcast if it is small."""
    return F.broadcast(keys) if keys.count() <= MOST_KEYS else keys


def without(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``docs`` but for those with one of the keys."""
    return docs.join(hinted(checkpointed(keys.select(key))), key, "left_anti").select(docs.columns)


def with_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with these columns; a column of the same name, in any case, is replaced."""
    lower = {c.lower() for c in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in lower]
    return df.select(*kept, *(c.alias(n) for n, c in columns.items()))


def boxed(df: DataFrame, **columns: Column) -> DataFrame:
    """``row``, all columns of ``df`` as one struct, and these columns: their names can't clash with any of ``df``."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(c.alias(n) for n, c in columns.items()))


def unboxed(df: DataFrame, of: DataFrame, **columns: Column) -> DataFrame:
    """The columns of ``of`` out of ``row`` again, and these; one of the same name, in any case, is replaced."""
    lower = {c.lower() for c in columns}
    kept = [F.col("row").getField(c).alias(c) for c in of.columns if c.lower() not in lower]
    return df.select(*kept, *(c.alias(n) for n, c in columns.items()))
