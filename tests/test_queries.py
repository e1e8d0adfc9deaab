"""Every query of the package against its SQL on the smallest tables."""

import duckdb
import pytest

from plotweave.plans import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DIR)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    norm = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert norm(tuple(r[c] for c in cols) for r in got.collect()) == norm(want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
