import os

import duckdb
import pytest

from compare import same
from sieveline.plans import file_queries, queries

QUERIES, SQL = queries.QUERIES | file_queries.QUERIES, queries.SQL | file_queries.SQL


@pytest.fixture(scope="session")
def con(data):
    c = duckdb.connect()
    for f in sorted(os.listdir(data)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in SQL:
        assert same(got, con.execute(SQL[name]).df()) == ""
    assert len(set(got.columns)) == len(got.columns)
