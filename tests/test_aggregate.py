"""Grouped and scalar aggregates on small tables with known answers; errors; empty inputs."""

import math

import pytest

from lumenfold.functions import names
from lumenfold.operators import Agg, aggregate, group_aggregate, hash_join, repeat_rows, scalar_aggregate

PAIRS = [(1, 11), (1, 12), (1, 13), (1, 14), (2, 21), (2, 22), (2, 23), (3, 31), (3, 32), (4, 41)]
NULLS = [(1, 1), (1, None), (2, 2), (None, 5), (None, None), (3, None)]


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(NULLS)], "k int, v int, at int")


def one(df, function, columns="v", **options):
    return scalar_aggregate(df, [Agg(function, columns, "x", options)]).first().x


@pytest.mark.parametrize("lanes", [1, 8])
def test_counts(spark, lanes):
    rows = spark.createDataFrame([(i,) for i in range(1, 11)], "i32 int")
    assert one(repeat_rows(rows, lanes), "count", "i32") == 10 * lanes
    pairs = repeat_rows(spark.createDataFrame(PAIRS, "key_i32 int, agg_i32 int"), lanes)
    out = group_aggregate(pairs, ["key_i32"], [Agg("hash_count", "agg_i32", "count")])
    assert out.dtypes == [("key_i32", "int"), ("count", "bigint")]
    assert {tuple(r) for r in out.collect()} == {(1, 4 * lanes), (2, 3 * lanes), (3, 2 * lanes), (4, lanes)}


def test_null_groups(nulls):
    out = aggregate(nulls, ["k"], [Agg("hash_count", "v", "n"), Agg("hash_sum", "v", "s")])
    assert {tuple(r) for r in out.collect()} == {(1, 1, 1), (2, 1, 2), (None, 1, 5), (3, 0, None)}


def test_values(spark, nulls):
    assert one(nulls, "count", mode="only_null") == 3 and one(nulls, "count", mode="all") == 6 and one(nulls, "count_all", ()) == 6
    assert one(nulls, "count_distinct") == 3 and one(nulls, "count_distinct", mode="all") == 4 and one(nulls, "count_distinct", mode="only_null") == 1
    assert one(nulls, "sum") == 8 and one(nulls, "sum", skip_nulls=False) is None and one(nulls, "sum", min_count=4) is None
    assert one(nulls.where("v IS NULL"), "sum", min_count=0) == 0
    assert math.isclose(one(nulls, "mean"), 8 / 3) and one(nulls, "product", exact=True) == 10 and one(nulls, "product") == 10.0
    assert tuple(one(nulls, "min_max")) == (1, 5)
    assert math.isclose(one(nulls, "variance"), 26 / 9) and math.isclose(one(nulls, "variance", ddof=1), 13 / 3)
    assert math.isclose(one(nulls, "variance", ddof=2), 26 / 3) and math.isclose(one(nulls, "stddev"), (26 / 9) ** 0.5)
    assert math.isclose(one(nulls, "skew"), 0.528, abs_tol=1e-3) and math.isclose(one(nulls, "kurtosis"), -1.5)
    assert one(nulls, "approximate_median") == 2.0 and one(nulls, "tdigest", q=(0.0, 1.0)) == [1.0, 5.0]
    assert one(nulls, "first", order_by="at") == 1 and one(nulls, "last", order_by="at") == 5 and one(nulls, "last", order_by="at", skip_nulls=False) is None
    assert tuple(one(nulls, "first_last", order_by="at")) == (1, 5)
    assert one(nulls, "index", value=2, position="at") == 2 and one(nulls, "index", value=9, position="at") == -1
    bools = spark.createDataFrame([(True,), (None,), (False,)], "v boolean")
    assert one(bools, "any") is True and one(bools, "all") is False and one(bools, "any", skip_nulls=False) is True
    assert one(bools.where("v IS NULL OR v"), "all") is True and one(bools.where("v IS NULL OR v"), "all", skip_nulls=False) is None


def test_lists(nulls):
    out = group_aggregate(nulls, ["k"], [Agg("hash_list", "v", "l"), Agg("hash_distinct", "v", "d"), Agg("hash_distinct", "v", "a", {"mode": "all"}), Agg("hash_one", "k", "o")])
    got = {r.k: (sorted(map(str, r.l)), r.d, set(r.a), r.o) for r in out.collect()}
    assert got == {1: (["1", "None"], [1], {1, None}, 1), 2: (["2"], [2], {2}, 2), 3: (["None"], [], {None}, 3), None: (["5", "None"], [5], {5, None}, None)}


def test_pivot(spark):
    rows = spark.createDataFrame([(1, "h", 10), (1, "w", 20), (2, "w", 5)], "id int, key string, v int")
    out = group_aggregate(rows, ["id"], [Agg("hash_pivot_wider", ("key", "v"), "p", {"key_names": ("h", "w")})])
    assert {r.id: tuple(r.p) for r in out.collect()} == {1: (10, 20), 2: (None, 5)}


def test_nan_and_overflow(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert math.isnan(one(rows, "max")) and one(rows, "max", skip_nan=True) == 1.0
    big = spark.createDataFrame([(2**63 - 1,), (2,)], "v long")
    with pytest.raises(Exception, match="OVERFLOW"):
        one(big, "sum")
    assert one(big, "sum", wrap=True) == -(2**63) + 1


def test_floats_as_keys(spark):
    rows = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "k double")
    assert group_aggregate(rows, ["k"], [Agg("hash_count_all", name="n")]).count() == 2
    assert hash_join(rows, rows, ["k"], ["k"], suffixes=("", "_r")).count() == 8


def test_empty(nulls):
    none = nulls.where("false")
    assert [tuple(r) for r in scalar_aggregate(none, [Agg("count", "v", "n"), Agg("sum", "v", "s")]).collect()] == [(0, None)]
    assert group_aggregate(none, ["k"], [Agg("hash_count", "v", "n")]).count() == 0


@pytest.mark.parametrize("keys,bad", [([], Agg("nope", "v")), (["k"], Agg("sum", "v")), ([], Agg("hash_sum", "v")), ([], Agg("sum", ())), ([], Agg("sum", "zzz")), ([], Agg("sum", "v", options={"odd": 1})), ([], Agg("list", "v")), (["k"], Agg("hash_index", "v")), ([], Agg("first", "v")), ([], Agg("count", "v", options={"mode": "x"}))])
def test_errors(nulls, keys, bad):
    with pytest.raises(ValueError):
        aggregate(nulls, keys, [bad])


def test_registry_is_whole():
    scalar = "count count_all count_distinct sum mean product min max min_max any all variance stddev skew kurtosis approximate_median tdigest first last first_last index pivot_wider"
    assert set(names(False)) == set(scalar.split())
    assert {n.removeprefix("hash_") for n in names(True)} == set(scalar.split()) - {"index"} | {"distinct", "list", "one"}


def test_partial_before_shuffle(nulls):
    plan = aggregate(nulls, ["k"], [Agg("hash_sum", "v", "s")])._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan


@pytest.mark.parametrize("seed", range(4))
def test_whole_products(spark, seed):
    import random

    draw = random.Random(seed)
    groups = {}
    for k in range(40):
        values = [draw.choice([-1, 1, draw.randint(-60, 60), draw.choice([None, 1, 2, -3, 10**6, -(2**31)])]) for _ in range(draw.randint(0, 12))]
        want = math.prod(v for v in values if v is not None)
        if abs(want) < 2**63:
            groups[k] = (values, want if any(v is not None for v in values) else None)
    groups[90], groups[91] = ([-(2**63)], -(2**63)), ([2] * 62 + [-1], -(2**62))
    groups[92] = ([10**18] * 9 + [0], 0)
    rows = spark.createDataFrame([(k, v) for k, (values, _) in groups.items() for v in values], "k long, v long").repartition(5)
    got = {r.k: r.p for r in group_aggregate(rows, ["k"], [Agg("hash_product", "v", "p")]).collect()}
    assert got == {k: want for k, (values, want) in groups.items() if values}
    with pytest.raises(Exception, match="64 bits|OVERFLOW|out of range"):
        scalar_aggregate(spark.createDataFrame([(2**62,), (2,)], "v long"), [Agg("product", "v", "p")]).collect()
    with pytest.raises(Exception, match="64 bits"):
        scalar_aggregate(spark.createDataFrame([(10**10,)] * 3, "v long"), [Agg("product", "v", "p")]).collect()


def test_product_sums_before_the_shuffle(nulls):
    plan = aggregate(nulls, ["k"], [Agg("hash_product", "v", "p")])._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "collect" not in plan


def test_decimal_types(spark):
    rows = spark.sql("SELECT CAST(x AS DECIMAL(5,2)) AS v FROM VALUES (1.00), (2.01) AS t(x)")
    out = scalar_aggregate(rows, [Agg("sum", "v", "s"), Agg("mean", "v", "m")])
    assert dict(out.dtypes) == {"s": "decimal(38,2)", "m": "decimal(5,2)"} and [str(x) for x in out.first()] == ["3.01", "1.51"]


def test_pivot_refuses_a_second_value(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, v int")
    pivot = Agg("pivot_wider", ("k", "v"), "p", {"key_names": ("a", "b", "c")})
    assert tuple(scalar_aggregate(rows, [pivot]).first().p) == (1, 2, None)
    with pytest.raises(Exception, match="more than one value"):
        scalar_aggregate(rows.union(rows), [pivot]).collect()


def test_own_aggregates(nulls):
    from pyspark.sql import functions as F

    from lumenfold.functions.aggregates import REGISTRY, register

    register("spread", lambda c, scale=1: (F.max(c) - F.min(c)) * scale)
    try:
        low, high = nulls.agg(F.min("v"), F.max("v")).first()
        assert scalar_aggregate(nulls, [Agg("spread", "v", "s", {"scale": 2})]).first().s == 2 * (high - low)
        assert "s" in group_aggregate(nulls, ["k"], [Agg("hash_spread", "v", "s")]).columns
        for bad in ("spread", "hash_x", ""):
            with pytest.raises(ValueError):
                register(bad, F.max)
    finally:
        del REGISTRY["spread"]


def test_default_quantiles_are_near(spark):
    rows = spark.range(100_000).selectExpr("CAST(pow(id, 1.7) AS DOUBLE) AS v").repartition(6)
    out = scalar_aggregate(rows, [Agg("approximate_median", "v", "m"), Agg("tdigest", "v", "q", {"q": (0.01, 0.25, 0.999)})]).first()
    ranks = [round(x ** (1 / 1.7)) / 100_000 for x in (out.m, *out.q)]
    assert all(abs(r - p) <= 0.0005 for r, p in zip(ranks, (0.5, 0.01, 0.25, 0.999), strict=True))
