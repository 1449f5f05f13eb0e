"""Every query with an SQL oracle, Spark vs DuckDB on the sf0.001 tables
(the same comparison the driver runs at sf0.01: row count, column names,
order-insensitive hash of the rows)."""

import os

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E
from wordspace.plans import catalog
from tools.oracle_check import TABLES, digest, type_mismatches




@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    ocols, otypes = rel.columns, rel.types
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert type_mismatches(df.dtypes, ocols, otypes) == []
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)


def test_every_query_has_a_callable_and_oracles_are_registered():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert all(callable(f) for f in q.values())
