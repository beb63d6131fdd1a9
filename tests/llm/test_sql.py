"""The queries that SQL can express against their SQL."""

import collections
import glob
import os

import duckdb
import pytest

from conftest import SMALL
from doclake.llm.oracle import ORACLES
from doclake.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    want = collections.Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
    assert collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want
