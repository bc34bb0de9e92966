"""Row transforms: projection, repetition, re-batching, materialisation, sorting, recursive series."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def project(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Columns or SQL expressions."""
    return df.select(*[F.expr(c) if isinstance(c, str) else c for c in columns])


def identity(df: DataFrame) -> DataFrame:
    return df


def append(df: DataFrame, other: DataFrame) -> DataFrame:
    """df's rows and then another source's, none dropped: UNION ALL by name."""
    return df.unionByName(other)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema, drain: Callable[[], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """Any function of Arrow batches, for what expressions can't say. drain() may yield more when a partition ends."""

    def run(batches):
        for batch in batches:
            yield function(batch)
        if drain is not None:
            yield from drain()

    return df.mapInArrow(run, schema)


def fresh(name: str, *tables: DataFrame) -> str:
    """name, with underscores before it until no table has such a column."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def new_column(df: DataFrame, *names: str) -> None:
    """An operator that adds columns must not replace the table's own."""
    for name in names:
        if name.lower() in map(str.lower, df.columns):
            raise ValueError(f"the table already has a column {name!r}")


def repeat_rows(df: DataFrame, times: int) -> DataFrame:
    """Every row `times` times: a generator inside the task, without a join or a shuffle."""
    if times < 0:
        raise ValueError("times must not be negative")
    copy = fresh("copy", df)
    return df.withColumn(copy, F.explode(F.sequence(F.lit(1), F.lit(times)) if times else F.array().cast("array<int>"))).drop(copy)


def polynomial(df: DataFrame, times: int, extra: DataFrame, depth: int) -> DataFrame:
    """Repeat by `times` and append `extra`, `depth` times over: n rows become f(depth), f(k) = times f(k-1) + |extra|."""
    for _ in range(depth):
        df = append(repeat_rows(df, times), extra)
    return df


def batches_of(df: DataFrame, size: int, order_by: Sequence[str], lane: str | None = None) -> DataFrame:
    """df with batch_id, which numbers runs of exactly `size` rows (the last may be shorter) in the given order, within
    each lane. The order is cut into ranges, and what is counted across them is a number for each range and lane, so that
    no task sees more than its range, also if a lane has a third of all rows."""
    if size < 1:
        raise ValueError("size must be positive")
    new_column(df, "batch_id")
    row_id = fresh("row_id", df)
    numbered = number_rows(df, order_by, row_id, lane)
    return numbered.withColumn("batch_id", F.floor(F.col(row_id) / size).cast("long")).drop(row_id)


def number_rows(df: DataFrame, order_by: Sequence[str], name: str = "row_id", lane: str | None = None) -> DataFrame:
    """df with a column `name`: 0, 1, ... in a global order, or in each lane's. Rows that are equal in order_by stand in
    any order.

    The ordered rows are checkpointed, so that the counts and the rows come from the same ranges even if a task is run
    again.
    """
    new_column(df, name)
    part, place, start, group = (fresh(n, df) for n in ("part", "place", "start", "group"))
    order = [lane, *order_by] if lane is not None else list(order_by)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id())
    # monotonically_increasing_id holds the place within the partition in its low 33 bits.
    ranged = materialize(ranged.withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    own = F.col(lane) if lane is not None else F.lit(0)
    runs = ranged.groupBy(F.col(part).alias(f"{part}_"), own.alias(group)).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    earlier = Window.partitionBy(group).orderBy(f"{part}_").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(f"{part}_", group, (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias(start))
    # A row for each range (and lane in it): the window above sees the ranges of a lane, not its rows.
    same = (F.col(part) == F.col(f"{part}_")) & own.eqNullSafe(F.col(group))
    return ranged.join(runs, same).select(*df.columns, (F.col(start) + F.col(place)).alias(name))


def materialize(df: DataFrame) -> DataFrame:
    """Everything is computed before anything goes on: a reliable checkpoint, which survives lost executors."""
    from ..sources import shared_folder

    shared_folder(df.sparkSession)
    return df.checkpoint()


def sort_rows(df: DataFrame, *columns: str, descending: bool = False, nulls: str = "first") -> DataFrame:
    """A total order by range partitioning; nulls "first" or "last" whatever the direction."""
    if nulls not in ("first", "last"):
        raise ValueError("nulls must be first or last")
    name = f"{'desc' if descending else 'asc'}_nulls_{nulls}"
    return df.orderBy(*[getattr(F.col(c), name)() for c in columns])


def recursive_series(spark: SparkSession, n: int) -> DataFrame:
    """i and the i-th Fibonacci number for i = 1..n (at most 92, which a long holds), by a recursive query."""
    if not 1 <= n <= 92:
        raise ValueError("n must be from 1 to 92")
    # The last step would need the number after the last, which a long may not hold any more: it stays null.
    return spark.sql(f"""
        WITH RECURSIVE series(i, v, following) AS (
          SELECT 1, CAST(1 AS BIGINT), CAST(1 AS BIGINT)
          UNION ALL
          SELECT i + 1, following, try_add(v, following) FROM series WHERE i < {int(n)}
        ) SELECT i, v FROM series""")
