"""A source that a producer fills while consumers read it, and a listener to what streams do."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from . import file_stream, run_available


class Produced:
    """A bounded queue of batches between one producer and several consumers.

    put() writes a batch to the shared folder and blocks while some consumer is `capacity` batches behind, so that a slow
    consumer holds the producer up and not memory. Every consumer gets every batch, in batches of one trigger each, once.
    close() ends all consumers after what was put before; fail(error) does the same and then raises the error in all of
    them. An error of a consumer's sink is raised in that consumer, and in the producer's next put().
    """

    def __init__(self, spark: SparkSession, schema: str, folder: str, consumers: Sequence[str], capacity: int = 4):
        if capacity < 1 or not consumers or len(set(consumers)) < len(consumers):
            raise ValueError("a capacity of 1 at least and consumers of different names are needed")
        self.spark, self.schema, self.capacity = spark, schema, capacity
        self.folder = f"{folder.rstrip('/')}/produced-{uuid.uuid4().hex}"
        self.change = threading.Condition()
        self.batches, self.ended = 0, False
        self.error: BaseException | None = None
        self.taken = dict.fromkeys(consumers, 0)
        spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{self.folder}/batches")

    def put(self, rows: DataFrame | Sequence) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(list(rows), self.schema)
        with self.change:
            self.change.wait_for(lambda: self.ended or self.batches - min(self.taken.values()) < self.capacity)
            if self.ended:
                raise self.error or ValueError("the source is closed")
        # One file is one batch, and one batch is one trigger: the bound counts both alike.
        df.select(*self.spark.createDataFrame([], self.schema).columns).coalesce(1).write.mode("append").parquet(f"{self.folder}/batches")
        with self.change:
            self.batches += 1
            self.change.notify_all()

    def close(self) -> None:
        self.end(None)

    def fail(self, error: BaseException) -> None:
        self.end(error)

    def end(self, error: BaseException | None) -> None:
        with self.change:
            if not self.ended:
                self.ended, self.error = True, error
            self.change.notify_all()

    def consume(self, name: str, commit: Callable[[DataFrame, int], None]) -> int:
        """Passes every batch to commit(batch, number) until the source ends; returns how many there were."""
        if name not in self.taken:
            raise ValueError(f"no consumer {name!r}; there are {', '.join(self.taken)}")
        stream = file_stream(self.spark, f"{self.folder}/batches", self.schema)
        read = 0
        try:
            while True:
                with self.change:
                    self.change.wait_for(lambda: self.batches > read or self.ended)
                    there, ended = self.batches, self.ended
                if there > read:
                    run_available(stream, commit, f"{self.folder}/state-{name}")
                    # A run takes what was there when it began, and perhaps more, which the next one then won't find.
                    read = there
                    with self.change:
                        self.taken[name] = max(self.taken[name], read)
                        self.change.notify_all()
                elif ended:
                    if self.error is not None:
                        raise self.error
                    return read
        except BaseException as e:
            self.end(e)
            raise


class Progress(StreamingQueryListener):
    """Keeps what Spark reports of streaming queries: starts, batches with their rows, ends and their errors.

    Add it with spark.streams.addListener(listener); reports come a little after the fact."""

    def __init__(self, most: int = 10_000):
        self.most, self.started, self.batches, self.ended = most, [], [], []

    def keep(self, found: list, entry) -> None:
        found.append(entry)
        del found[: -self.most]

    def onQueryStarted(self, event) -> None:
        self.keep(self.started, str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.keep(self.batches, {"query": str(p.id), "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.keep(self.ended, {"query": str(event.id), "error": event.exception})
