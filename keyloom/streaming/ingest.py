"""Structured Streaming: new artifact files as rows, counted by event time, appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def new_rows(spark: SparkSession, folder: str, schema: StructType | str, fmt: str = "parquet", files_per_batch: int = 64) -> DataFrame:
    """Files that appear in `folder`, each read once; at most `files_per_batch` of them in a micro-batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)


def per_window(events: DataFrame, time: str, by: list[str], size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, by..., n): rows per window and key; state is dropped once rows may no longer be late.

    The time column may be without a zone; it is taken as UTC in a session set to UTC.
    """
    at = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    counted = at.groupBy(F.window("_t", size).alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), *by, "n")


def unique_rows(rows: DataFrame, key: str, time: str, late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark."""
    at = rows.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return at.dropDuplicatesWithinWatermark([key]).drop("_t")


def append(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append all rows that are there now to a Parquet folder, exactly once across restarts."""
    return (
        rows.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
