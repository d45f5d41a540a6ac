"""The registered queries against their SQL."""

import os

import duckdb
import pytest

from heddle.llm import queries
from tests.test_jobs import SF, TABLES, plain


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLES[name])
    columns, names = sorted(got.columns), [c[0] for c in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(got.select(columns).collect()) == plain([tuple(r[i] for i in order) for r in want.fetchall()])
