"""Every query on the small tables against its SQL, and the shape of the plans that matter at scale."""

import collections
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL
from doclake.plans.registry import QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(_value(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = collections.Counter(tuple(_value(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
    assert got == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_clean_up_needs_no_shuffle_and_no_python(spark):
    from doclake.operators.markdown import clean_markdown
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    plan = _plan(clean_markdown(docs))
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_pairs_all_rows(spark, name):
    if name.startswith("stream_"):
        pytest.skip("runs as a stream")
    plan = _plan(entry.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_smoke(spark):
    assert entry.entry(spark).count() == 200
