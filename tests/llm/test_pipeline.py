"""The pipeline's stages against plain versions on a small table, and the registered queries at the smallest scale."""

import os
import random

import pytest
from data import frame, prose

import corpus_pipeline
from lumenfold.llm import pii, queries

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    draw = random.Random(6)
    texts = [prose(draw, ["en", "fr", "de"][i % 3], 60) for i in range(40)]
    leak = prose(draw, "en", 30)
    data = [(i, t, ["en", "fr", "de"][i % 3], "s", len(t)) for i, t in enumerate(texts)]
    data += [(100, texts[3], "en", "s", 0), (101, texts[4] + " more", "fr", "s", 0), (102, leak, "en", "s", 0), (103, f"{texts[0][:150]} {leak} {texts[1][:150]}", "en", "s", 0), (104, None, "en", "s", 0), (105, "123", "en", "s", 0), (106, "write to a@b.cc " + prose(draw, "de", 50), "de", "s", 0)]
    docs = frame(spark, data, extra=False)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        at = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert at.columns == docs.columns and at.dtypes == docs.dtypes
        kept.append({r.doc_id: r for r in at.collect()})
    ids = {d[0] for d in data}
    assert set(kept[0]) == ids - {104, 105}
    assert set(kept[1]) == set(kept[0]) - {100, 101}
    assert set(kept[2]) == set(kept[1]) - {102, 103}
    assert set(kept[3]) == set(kept[2]) and kept[3][106].text.startswith("write to <email> ") and kept[3][106].n_chars == len(kept[3][106].text)
    assert all(not [s for s in pii.spans(r.text) if s[2] in pii.PERSONAL] for r in kept[3].values())
    last = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
    assert {r.doc_id for r in last} == set(kept[3])
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, last))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.queries()))
def test_registered(spark, name):
    df = queries.queries()[name](spark, DATA)
    table = "pages" if name.startswith("op10") else "documents"
    n = df.count()
    if name.startswith(("op1_", "op2_")):
        assert n > 0
    else:
        assert n == spark.read.parquet(f"{DATA}/{table}.parquet").count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    mine = queries.queries()[name](spark, DATA).toPandas()
    theirs = con.execute(queries.oracle_sql()[name]).df()[list(mine.columns)]
    plain = lambda df: sorted(df.astype(object).where(df.notna(), None).itertuples(index=False, name=None), key=str)
    assert len(mine) and plain(mine) == plain(theirs)


def test_names():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
    assert len(corpus_pipeline.STAGES) == 5
