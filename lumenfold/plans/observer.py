"""What passes the points of a pipeline while it runs: rows and any aggregates, gathered by the tasks that make them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Observer:
    """Watches DataFrames under names; what it saw is there once an action on the pipeline's result has ended.

    The counts ride on the query itself, so that nothing is computed twice. Points with the same name get a number. A
    point that the plan doesn't run, since its rows can't matter, has no counts. If a stage runs again after an executor
    was lost, its rows are seen again.
    """

    def __init__(self, **more: Column):
        self.more, self.points = more, {}
        self.done: list[Callable[[dict], None]] = []

    def watch(self, point: str, df: DataFrame) -> DataFrame:
        name, k = point, 1
        while name in self.points:
            k += 1
            name = f"{point} {k}"
        self.points[name] = Observation(name)
        return df.observe(self.points[name], F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in self.more.items()])

    def on_end(self, call: Callable[[dict], None]) -> None:
        """call(what was seen) when seen() is asked for the first time after the action."""
        self.done.append(call)

    def seen(self) -> dict[str, dict]:
        """For each point its row count and the aggregates; to be called after the action."""
        found = {name: dict(o.get) for name, o in self.points.items()}
        while self.done:
            self.done.pop(0)(found)
        return found
