"""Sources and sinks: tables, rows in memory, lanes, and where results go."""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder, by any path Spark reads; only the columns and row groups a query needs are read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def from_rows(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def from_batches(spark: SparkSession, batches: Sequence[pa.RecordBatch]) -> DataFrame:
    """A bag of Arrow batches with one schema."""
    return spark.createDataFrame(pa.Table.from_batches(batches))


def parallel_source(df: DataFrame, lanes: int, order_by: Sequence[str], most: int) -> DataFrame:
    """df with lane and slice: contiguous ranges of ceil(n / lanes) rows in the given order, each in slices of at most
    `most` rows, as a parallel source would emit them."""
    from ..operators.transform import fresh, new_column, number_rows

    if lanes < 1 or most < 1:
        raise ValueError("lanes and most must be positive")
    new_column(df, "lane", "slice")
    row_id = fresh("row_id", df)
    n = df.count()
    each = max(1, -(-n // lanes))
    numbered = number_rows(df, order_by, row_id)
    return numbered.select(*df.columns, F.floor(F.col(row_id) / each).cast("int").alias("lane"), F.floor(F.col(row_id) % each / most).cast("int").alias("slice"))


def every_lane(df: DataFrame, lanes: int) -> DataFrame:
    """A full copy of df for each lane."""
    from ..operators.transform import repeat_rows

    return repeat_rows(df, lanes)


def single_row(spark: SparkSession, value: int = 1) -> DataFrame:
    return spark.range(1).select(F.lit(value).cast("long").alias("v"))


def endless(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    """A stream without an end."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def black_hole(df: DataFrame) -> None:
    """Computes every row and keeps none."""
    df.write.format("noop").mode("overwrite").save()


def memory_sink(df: DataFrame) -> list[Row]:
    """All rows on the driver; for small results."""
    return df.collect()


def rows_of_partitions(df: DataFrame) -> dict[int, list[Row]]:
    """The rows each partition holds, on the driver; for small results."""
    part = df.columns and "part"
    while part in df.columns:
        part = f"_{part}"
    found: dict[int, list[Row]] = defaultdict(list)
    for r in df.withColumn(part, F.spark_partition_id()).collect():
        values = r.asDict(recursive=False)
        found[values.pop(part)].append(Row(**values))
    return dict(found)


def rows_by_partition(df: DataFrame) -> dict[int, int]:
    """How many rows each partition holds."""
    found: dict[int, int] = defaultdict(int)
    for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect():
        found[r.p] = r.n
    return dict(found)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors share: spark.checkpoint.dir, or in a local session without it a temporary
    folder. A cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lumenfold-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named
