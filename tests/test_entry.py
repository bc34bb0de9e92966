"""The driver's contract, every relational query against its SQL at the smallest scale, and plans."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from lumenfold import catalog
from lumenfold.sources import TABLES

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.oracle_sql()) == set(catalog.queries())


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, tables, name):
    df = catalog.queries()[name](spark, DATA)
    names = sorted(df.columns)
    found = tables.sql(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = sorted(tuple(plain(row[columns.index(n)]) for n in names) for row in found.fetchall())
    assert sorted(tuple(plain(row[n]) for n in names) for row in df.collect()) == want


@needs_data
def test_scans_read_what_they_need(spark):
    plan = catalog.queries()["join_agg"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan
    assert "PushedFilters: [IsNotNull(o_custkey)]" in plan and "partial_" in plan


@needs_data
def test_whole_joins_take_every_order_and_customer(spark):
    orders, customers = (spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("orders", "customer"))
    run = lambda name: catalog.queries()[name](spark, DATA)
    assert run("join_left_outer").select("o_orderkey").distinct().count() == orders
    assert run("join_right_outer").select("c_name").distinct().count() == customers
    assert run("join_left_semi").count() + run("join_left_anti").count() == orders
    assert run("join_anti_empty_build").count() == orders
    same = run("join_null_safe")
    assert same.where("ck IS NULL").count() > 0 and same.where("ck IS NOT NULL").count() > 0


@needs_data
def test_whole_channels_take_every_row(spark):
    run = lambda name: catalog.queries()[name](spark, DATA)
    rows = {t: spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("orders", "customer", "supplier", "lineitem", "events")}
    assert run("union_map_pipes").count() == 2 * rows["orders"]
    assert run("union_shared_right_join").where("nation IS NOT NULL").count() == rows["customer"] + rows["supplier"]
    matched = run("union_of_right_joins").agg({"matched": "sum"}).first()[0]
    assert 0.9 * 2 * (rows["orders"] + 2 * rows["lineitem"] + rows["events"]) < matched


def test_exact_product_of_many_rows(spark):
    from lumenfold.operators import Agg, aggregate

    rows = spark.range(200_000).selectExpr("CASE WHEN id % 7 = 0 THEN NULL WHEN id IN (1, 2, 3) THEN id + 1 WHEN id % 2 = 0 THEN -1 ELSE 1 END AS x")
    negative = sum(i % 7 != 0 and i not in (1, 2, 3) and i % 2 == 0 for i in range(200_000))
    exact = lambda df: aggregate(df, [], [Agg("product", "x", "v", {"exact": True})])
    assert exact(rows).first().v == 24 * (-1) ** negative
    assert exact(rows.where("false")).first().v is None
    big = spark.range(100).selectExpr("CASE WHEN id = 99 THEN 0 ELSE 9 END AS x")
    assert exact(big).first().v == 0  # the others alone overflow


@needs_data
def test_whole_product_reads_every_line(spark):
    plan = catalog.queries()["agg_scalar_product"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: []" in plan and "Filter (" not in plan


def test_no_query_leaves_rows_out():
    import inspect

    text = inspect.getsource(catalog)
    assert "o_orderkey % 3" not in text and "l_orderkey < 8" not in text and ".limit(" not in text
