"""The cleaning chain and the append of new rows on streams of files.

The chain looks at one row at a time, so a stream needs no state and no watermark for it. Limits on
requests keep a count for each user and minute.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from ..operators.cleaning import clean


def read(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def clean_stream(rows: DataFrame, **options) -> DataFrame:
    return clean(rows, **options)


def write_available(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All files that are there now, once each: a run that broke off goes on where it stopped."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def for_each_batch(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def per_minute(requests: DataFrame, at: str = "ts", user: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """Requests of each user in each minute, as a limit on them would count."""
    return requests.withWatermark(at, late).groupBy(F.window(at, "1 minute"), user).agg(F.count("*").alias("n"))


def limited(requests: DataFrame, most: int, key: str = "request_id", at: str = "ts", user: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """Each request once, with ``allowed``: whether it is among its user's first ``most`` of its minute.

    A request that comes again under its key, or later than ``late``, gives no row. A minute's count is kept until no more of it can
    come, also over a restart from the query's checkpoint; requests that come together count in the order of their times and keys.
    """
    once = requests.withWatermark(at, late).dropDuplicatesWithinWatermark([key]).withColumn("_minute", F.date_trunc("minute", at))
    names = requests.columns

    def count(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get[0] if state.exists else 0
        rows = pd.concat(batches).sort_values([at, key])
        rows["allowed"] = [before + i < most for i in range(len(rows))]
        state.update((before + len(rows),))
        state.setTimeoutTimestamp(int(group[1].timestamp() * 1000) + 60_000)
        yield rows[[*names, "allowed"]]

    schema = StructType([*requests.schema.fields, StructField("allowed", BooleanType())])
    return once.groupBy(user, "_minute").applyInPandasWithState(count, schema, "n long", "append", GroupStateTimeout.EventTimeTimeout)
