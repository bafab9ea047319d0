"""The training-data queries that SQL can express, against their oracles; the others for their columns."""

import os

import pytest

from citegrid.llm import queries

DIR = os.environ.get("CITEGRID_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not there")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    got, sql = queries.queries()[name](spark, DIR), con.sql(queries.oracle_sql()[name])
    order = lambda rows, names: sorted(tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in sorted(range(len(names)), key=lambda i: names[i])) for r in rows)
    assert order(got.collect(), got.columns) == order(sql.fetchall(), sql.columns)


def test_names():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}
