"""Every catalogued query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from graphlake import queries as catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark".split()


def cell(v):
    return "~" if v is None else repr(round(v, 6)) if isinstance(v, float) and math.isfinite(v) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    df = catalogue.queries()[name](spark, SF)
    got = sorted(tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    columns = list(want.columns)
    assert got == sorted(tuple(cell(r[columns.index(c)]) for c in sorted(columns)) for r in want.fetchall())


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
