"""Streams end when told to, lose nothing, and raise what their sinks raise."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from lumenfold import sources
from lumenfold.streaming import Produced, Progress, available_aggregate, available_to_table, file_stream, run_available, stop_after


@pytest.fixture
def folder(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 3 AS k").repartition(7).write.parquet(str(tmp_path / "in"))
    return tmp_path


def stream(spark, folder, files=2):
    return file_stream(spark, str(folder / "in"), "id long, k long", files)


def test_bounded_triggers_lose_nothing(spark, folder):
    sizes, got = [], []

    def commit(batch, number):
        rows = [r.id for r in batch.collect()]
        sizes.append(len(rows))
        got.extend(rows)

    run_available(stream(spark, folder), commit, str(folder / "state"))
    assert sorted(got) == list(range(100)) and len(sizes) >= 4
    run_available(stream(spark, folder), commit, str(folder / "state"))  # nothing is left
    assert len(got) == 100


def test_error_is_raised_and_work_goes_on(spark, folder):
    got = []

    def first(batch, number):
        if number == 1:
            raise ValueError("sink is full")
        got.extend(r.id for r in batch.collect())

    with pytest.raises(Exception, match="sink is full"):
        run_available(stream(spark, folder), first, str(folder / "state"))
    run_available(stream(spark, folder), lambda b, n: got.extend(r.id for r in b.collect()), str(folder / "state"))
    assert sorted(got) == list(range(100))


def test_tables(spark, folder):
    out = available_to_table(stream(spark, folder).where("k = 1"), str(folder / "out"), str(folder / "s1"))
    assert out.count() == 33
    sums = available_aggregate(stream(spark, folder), ["k"], [F.count(F.lit(1)).alias("n")], str(folder / "agg"), str(folder / "s2"))
    assert {tuple(r) for r in sums.collect()} == {(0, 34), (1, 33), (2, 33)}


def test_endless_source_stops(spark, folder):
    seen = []
    query = sources.endless(spark, 100).writeStream.foreachBatch(lambda b, n: seen.append(b.count())).option("checkpointLocation", str(folder / "s3")).start()
    begin = time.monotonic()
    stop_after(query, lambda: sum(seen) > 0, 30)
    assert not query.isActive and sum(seen) > 0 and time.monotonic() - begin < 60


def consumers(source, names, commit):
    found, errors = {}, {}

    def run(name):
        try:
            found[name] = source.consume(name, lambda b, n: commit(name, b))
        except Exception as e:
            errors[name] = str(e)

    threads = [threading.Thread(target=run, args=(n,)) for n in names]
    for t in threads:
        t.start()
    return threads, found, errors


def test_producer_waits_and_all_get_all(spark, tmp_path):
    source, got, gate = Produced(spark, "v long", str(tmp_path), ["a", "b"], capacity=2), {"a": [], "b": []}, threading.Event()

    def commit(name, batch):
        if name == "b":
            gate.wait(60)
        got[name] += [r.v for r in batch.collect()]

    threads, found, errors = consumers(source, ["a", "b"], commit)
    done = []
    producer = threading.Thread(target=lambda: [(source.put([(i,)]), done.append(i)) for i in range(5)] and source.close())
    producer.start()
    time.sleep(8)
    assert len(done) == 2  # the slow reader holds the producer up
    gate.set()
    for t in (producer, *threads):
        t.join(120)
    assert not errors and found == {"a": 5, "b": 5} and sorted(got["a"]) == sorted(got["b"]) == list(range(5))
    with pytest.raises(ValueError):
        source.put([(9,)])


def test_an_error_reaches_all_consumers(spark, tmp_path):
    source, got = Produced(spark, "v long", str(tmp_path), ["a", "b"]), []
    threads, found, errors = consumers(source, ["a", "b"], lambda name, b: got.append((name, b.count())))
    source.put([(1,), (2,)])
    source.fail(ValueError("the producer broke"))
    for t in threads:
        t.join(120)
    assert errors == {"a": "the producer broke", "b": "the producer broke"} and not found
    assert sorted(x for x in got if x[1]) == [("a", 2), ("b", 2)]  # what was put before is not lost
    with pytest.raises(ValueError):
        Produced(spark, "v long", str(tmp_path), [])


def test_progress_is_heard(spark, folder):
    listener = Progress()
    spark.streams.addListener(listener)
    try:
        run_available(stream(spark, folder), lambda b, n: b.count(), str(folder / "state"))
        end = time.monotonic() + 30
        while not listener.ended and time.monotonic() < end:
            time.sleep(0.1)
        assert listener.started and listener.ended[0]["error"] is None and sum(b["rows"] for b in listener.batches) >= 100
    finally:
        spark.streams.removeListener(listener)
