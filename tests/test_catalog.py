"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from heapscope.catalog import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "null" if v != v else repr(round(v, 6))
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return "null" if v is None or v is pd.NaT else v.isoformat() if hasattr(v, "isoformat") else str(v)


def rows(table):
    names = sorted(table.schema.names)
    d = table.to_pydict()
    return sorted("|".join(map(plain, r)) for r in zip(*(d[n] for n in names), strict=True))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toArrow()
    if name not in ORACLE:
        assert got.num_rows
        return
    want = duck.sql(ORACLE[name]).to_arrow_table()
    assert sorted((f.name, str(f.type)) for f in got.schema) == sorted((f.name, str(f.type)) for f in want.schema)
    assert rows(got) == rows(want)


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
