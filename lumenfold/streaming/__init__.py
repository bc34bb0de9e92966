"""Bounded, backpressured streams: sources that give so much a time, sinks that commit batch by batch, clean ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def __getattr__(name: str):
    if name in ("Produced", "Progress"):
        from . import produced

        return getattr(produced, name)
    raise AttributeError(name)


def file_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream. A trigger takes so many files at most: the sink is never ahead of them."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(stream: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Passes all that is there to commit(batch, number), in bounded batches, and ends. An error in commit ends the
    query and is raised here; what was committed stays so, and a new call goes on behind it."""
    query = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stop_after(query: StreamingQuery, done: Callable[[], bool], seconds: float = 60.0) -> None:
    """Stops an endless query once done() says so, or when the time is over."""
    import time

    end = time.monotonic() + seconds
    try:
        while query.isActive and not done() and time.monotonic() < end:
            time.sleep(0.05)
        if (error := query.exception()) is not None:
            raise error
    finally:
        query.stop()


def available_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drains a stream into a Parquet table, exactly once for each batch, and reads it."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def available_aggregate(stream: DataFrame, keys: list[str], aggregates: list, path: str, checkpoint: str) -> DataFrame:
    """A grouped aggregate of all that is there. Each batch's state is kept by Spark; the last complete result is read."""

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number:09d}")

    grouped = stream.groupBy(*map(F.col, keys)).agg(*aggregates)
    query = run_available(grouped, commit, checkpoint, mode="complete")
    last = query.lastProgress
    return stream.sparkSession.read.schema(grouped.schema).parquet(f"{path}/{last.batchId:09d}")
