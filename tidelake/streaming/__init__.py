"""Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_parquet(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def daily_counts(events: DataFrame, at: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """Events per day and key; a day is closed once the watermark, ``late`` behind the newest event, has passed it."""
    day = F.window(at, "1 day")
    return events.withWatermark(at, late).groupBy(day, *keys).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), *keys, "n")


def deduplicated(events: DataFrame, at: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """The first event of each key; state is dropped after the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def run_available(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there now, in batches that a restart doesn't repeat, and returns the ended query."""
    query = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def merge_stream(events: DataFrame, merge: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Upserts each batch; replays of a batch are harmless because the merge keeps the latest row of each key."""
    return run_available(events, lambda df, _: merge(df), checkpoint)
