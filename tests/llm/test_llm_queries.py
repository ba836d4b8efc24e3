"""The registered queries of the package, those with SQL against it."""

import glob
import os

import duckdb
import pytest

from kinograph.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    cursor = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in cursor.description]
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    expected = sorted(tuple(show(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(map(show, r)) for r in frame.select(*columns).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE) - {"p5_limits", "p6_search"}))
def test_query_without_sql_has_rows(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0
