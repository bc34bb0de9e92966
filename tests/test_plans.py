"""Channels, shared pipes, transforms, sources and sinks."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lumenfold import sources
from lumenfold.operators import append, batches_of, identity, map_batches, materialize, polynomial, project, recursive_series, repeat_rows, sort_rows
from lumenfold.plans import Channel, Observer, Pipeline, join_pipe, map_pipe


def ints(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def values(df):
    return sorted((r[0] for r in df.collect()), key=str)


def test_union_keeps_all(spark):
    two = Pipeline("p", [Channel("a", ints(spark, 1, 2)), Channel("b", ints(spark, 2, 3))])
    assert values(two.compile()) == [1, 2, 2, 3]
    assert "channel b: b -> sink" in two.explain() and two.stages() == [["a", "b"]]


def test_shared_right_join_emits_unmatched_once(spark):
    build = ints(spark, 1, 2, 9).toDF("k")
    pipe = join_pipe("j", build, ["v"], ["k"], "right_outer")
    shared = Pipeline("p", [Channel("a", ints(spark, 1), [pipe]), Channel("b", ints(spark, 2, 3), [pipe])])
    assert sorted(map(str, map(tuple, shared.compile().collect()))) == ["(1, 1)", "(2, 2)", "(None, 9)"]
    assert shared.stages() == [["a", "b"], ["j"]]


def test_shared_pipes_of_different_depth(spark):
    one, two = (join_pipe(n, ints(spark, 1, 5).toDF(n), ["v"], [n], "right_outer", left_output=[], right_output=[n]) for n in ("x", "y"))
    rename = map_pipe("rename", lambda df: df.withColumnRenamed("x", "v"))
    deep = Pipeline("p", [Channel("a", ints(spark, 1), [one, rename, two]), Channel("b", ints(spark, 5), [two])])
    assert deep.stages() == [["a", "b"], ["x"], ["y"]]
    assert values(deep.compile()) == [1, 5, 5]


def test_plain_pipe_may_part(spark):
    double = map_pipe("double", lambda df: df.select((F.col("v") * 2).alias("v")))
    minus = map_pipe("minus", lambda df: df.select((-F.col("v")).alias("v")))
    assert values(Pipeline("p", [Channel("a", ints(spark, 1), [double, minus]), Channel("b", ints(spark, 2), [double])]).compile()) == [-2, 4]


def test_bad_pipelines(spark):
    with pytest.raises(ValueError):
        Pipeline("p", [])
    a, b = map_pipe("a", identity), map_pipe("b", identity)
    with pytest.raises(ValueError):
        Pipeline("p", [Channel("x", ints(spark, 1), [a, b]), Channel("y", ints(spark, 1), [b, a])]).compile()
    with pytest.raises(ValueError):
        Pipeline("p", [Channel("x", ints(spark, 1), [a, a])])


@pytest.mark.parametrize("x,y", [(1, 3), (2, 5), (3, 2), (4, 3)])
def test_power(spark, x, y):
    df = ints(spark, 7)
    for _ in range(y):
        df = repeat_rows(df, x)
    assert df.count() == x**y


@pytest.mark.parametrize("a,b,c", [(1, 1, 1), (2, 3, 4), (3, 9, 2)])
def test_composition(spark, a, b, c):
    want = 1
    for _ in range(c):
        want = a * want + b
    assert polynomial(ints(spark, 7), a, ints(spark, *range(b)), c).count() == want


def test_repeat_zero(spark):
    assert repeat_rows(ints(spark, 1, 2), 0).count() == 0
    with pytest.raises(ValueError):
        repeat_rows(ints(spark, 1), -1)


@pytest.mark.parametrize("n", [2, 10, 42, 92])
def test_recursion(spark, n):
    a, b, want = 1, 1, []
    for _ in range(n):
        want.append(a)
        a, b = b, a + b
    assert [r.v for r in recursive_series(spark, n).orderBy("i").collect()] == want


@pytest.mark.parametrize("lanes", [1, 7])
def test_sort(spark, lanes):
    df = repeat_rows(ints(spark, 1, 10, 100, 2, 20, 200, 3, 30, 300), lanes)
    assert [r.v for r in sort_rows(df, "v").collect()] == sorted([1, 10, 100, 2, 20, 200, 3, 30, 300] * lanes)


def test_sort_nulls(spark):
    df = ints(spark, 2, None, 1)
    assert [r.v for r in sort_rows(df, "v", nulls="last").collect()] == [1, 2, None]
    assert [r.v for r in sort_rows(df, "v", descending=True).collect()] == [None, 2, 1]


@pytest.mark.parametrize("lanes,most,n", [(1, 1, 0), (1, 4, 31), (2, 3, 10), (3, 4, 31), (3, 2, 1)])
def test_parallel_source(spark, lanes, most, n):
    df = spark.range(42, 42 + n).toDF("v")
    rows = sorted(map(tuple, sources.parallel_source(df, lanes, ["v"], most).collect()))
    each = max(1, -(-n // lanes))
    assert rows == [(42 + i, i // each, i % each // most) for i in range(n)]


def test_rebatch(spark):
    df = spark.createDataFrame([(lane, i) for lane in range(3) for i in range(5)], "lane int, v int")
    sizes = batches_of(df, 3, ["v"], lane="lane").groupBy("lane", "batch_id").count().collect()
    assert sorted(map(tuple, sizes)) == [(lane, b, 3 - b) for lane in range(3) for b in range(2)]
    assert sorted(r["count"] for r in batches_of(df, 4, ["v", "lane"]).groupBy("batch_id").count().collect()) == [3, 4, 4, 4]


def test_batches_and_drain(spark):
    schema = pa.schema([("v", pa.int32())])
    df = ints(spark, 1, 2, 3).coalesce(1)
    doubled = map_batches(df, lambda b: pa.RecordBatch.from_arrays([pc.multiply(b.column(0), 2).cast("int32")], schema=schema), "v int", lambda: iter([pa.RecordBatch.from_pydict({"v": pa.array([99], pa.int32())})]))
    assert values(doubled) == [2, 4, 6, 99]


def test_sources_and_sinks(spark):
    df = ints(spark, 1, 2, 3)
    assert values(append(identity(df), project(df, "v + 10 AS v"))) == [1, 11, 12, 13, 2, 3]
    assert values(sources.every_lane(df, 2)) == [1, 1, 2, 2, 3, 3] and values(materialize(df)) == [1, 2, 3]
    assert sources.memory_sink(sources.single_row(spark))[0].v == 1 and sources.endless(spark).isStreaming
    assert sum(sources.rows_by_partition(df.repartition(3)).values()) == 3 and sources.black_hole(df) is None
    batch = pa.RecordBatch.from_pydict({"v": pa.array([4, 5], pa.int32())})
    assert values(sources.from_batches(spark, [batch, batch])) == [4, 4, 5, 5]
    assert values(sources.from_rows(spark, [(8,)], "v int")) == [8]


def test_errors_surface(spark):
    with pytest.raises(Exception, match="no luck"):
        ints(spark, 1).select(F.raise_error(F.lit("no luck"))).collect()


def test_columns_of_ones_own_stay(spark):
    df = spark.createDataFrame([(i % 3, i, i, i, i, i, i) for i in range(20)], "lane int, copy int, _copy int, part int, place int, start int, row_id int")
    assert repeat_rows(df, 2).columns == df.columns and repeat_rows(df, 2).where("copy IS NULL OR _copy IS NULL").count() == 0
    for lane in (None, "lane"):
        out = batches_of(df, 4, ["place"], lane=lane)
        assert out.columns == [*df.columns, "batch_id"]
        assert sorted(tuple(r[:7]) for r in out.collect()) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        batches_of(batches_of(df, 4, ["place"]), 4, ["place"])
    with pytest.raises(ValueError):
        sources.parallel_source(df, 2, ["place"], 3)


def test_lanes_are_cut_into_ranges(spark):
    """Most rows in one lane, some in a null one: rows are numbered in order, and no task takes a whole lane."""
    rows = spark.range(5000).selectExpr("CASE WHEN id % 50 = 0 THEN NULL WHEN id % 10 = 0 THEN 'b' ELSE 'a' END AS lane", "id").repartition(6)
    got = batches_of(rows, 64, ["id"], lane="lane").collect()
    for lane in ("a", "b", None):
        mine = sorted((r.id, r.batch_id) for r in got if r.lane == lane)
        assert [b for _, b in mine] == [i // 64 for i in range(len(mine))]
    assert batches_of(rows.where("false"), 64, ["id"], lane="lane").count() == 0


def test_observer(spark):
    pipe = map_pipe("even", lambda df: df.where("v % 2 = 0"))
    seen, ends = Observer(total=F.sum("v")), []
    seen.on_end(ends.append)
    out = Pipeline("p", [Channel("a", ints(spark, 1, 2), [pipe]), Channel("b", ints(spark, 2, 4, 6), [pipe])]).compile(seen)
    assert values(out) == [2, 2, 4, 6]
    assert seen.seen() == {"source a": {"rows": 2, "total": 3}, "source b": {"rows": 3, "total": 12}, "pipe even": {"rows": 4, "total": 14}, "sink": {"rows": 4, "total": 14}}
    assert len(ends) == 1 and seen.seen() and len(ends) == 1


def test_rows_of_partitions(spark):
    found = sources.rows_of_partitions(ints(spark, *range(20)).withColumn("part", F.lit("own")).repartition(3))
    assert len(found) == 3 and sorted(r.v for rows in found.values() for r in rows) == list(range(20)) and found[0][0].part == "own"
