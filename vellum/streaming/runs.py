"""Runs that append: trial logs as a stream, and figures that follow them.

The batch operators have no event time. What grows is a folder of JSON rows, one file per batch
of a run; a stream over it skips rows of keys already done and keeps running figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def log(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def new_rows(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state is dropped behind it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def running(stream: DataFrame, time: str, every: str = "1 minute", late: str = "1 hour", value: str = "sec", *keys: str) -> DataFrame:
    """Count, total, mean, least and greatest per window of time."""
    return (
        stream.withWatermark(time, late).groupBy(F.window(time, every), *keys)
        .agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    )


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what there is to Parquet, and stop; started again, it goes on behind the last file."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
