"""Every registered query against its SQL oracle on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from citegrid.plans import catalog

DIR = os.environ.get("CITEGRID_TEST_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_oracle(spark, duck, name):
    got = entry.queries()[name](spark, DIR)
    sql = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(sql.columns)
    assert plain(got.collect(), got.columns) == plain(sql.fetchall(), sql.columns)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"left_seq", "right_seq", "score", "title_score", "author_score"} and df.count() >= 0
