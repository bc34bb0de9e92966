"""Scalar and grouped aggregation over the function registry.

Spark sums partially in every task, shuffles by the keys and finishes there; nothing is merged in one place but the one
row of a scalar aggregate. The result is a DataFrame like any other: keys in key order, then the aggregates by name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expression


@dataclass(frozen=True)
class Agg:
    """An aggregate: function name, target columns, output name, options."""

    function: str
    columns: Sequence[str] | str = ()
    name: str | None = None
    options: dict = field(default_factory=dict)

    def column(self, df: DataFrame, grouped: bool):
        targets = (self.columns,) if isinstance(self.columns, str) else tuple(self.columns)
        for c in (*targets, *(v for k, v in self.options.items() if k in ("order_by", "position"))):
            if df.columns.count(c) != 1:
                raise ValueError(f"column {c!r} is missing or ambiguous in {df.columns}")
        types = tuple(df.schema[c].dataType for c in targets)
        return expression(self.function, targets, grouped, self.options, types).alias(self.name or "_".join((self.function, *targets)))


def scalar_aggregate(df: DataFrame, aggregates: Sequence[Agg]) -> DataFrame:
    """One row, also from no rows."""
    return df.agg(*[a.column(df, grouped=False) for a in aggregates])


def group_aggregate(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Agg]) -> DataFrame:
    """A row for each combination of keys, null keys included; any number of keys and aggregates."""
    for k in keys:
        if df.columns.count(k) != 1:
            raise ValueError(f"key {k!r} is missing or ambiguous in {df.columns}")
    grouped = df.groupBy(*map(F.col, keys))
    return grouped.agg(*[a.column(df, grouped=True) for a in aggregates]) if aggregates else df.select(*keys).distinct()


def aggregate(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Agg]) -> DataFrame:
    return group_aggregate(df, keys, aggregates) if keys else scalar_aggregate(df, aggregates)
