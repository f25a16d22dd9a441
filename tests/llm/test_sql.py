"""Registered queries against their SQL."""

import duckdb
import pytest

from heapscope.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = con.sql(ORACLE[name]).to_arrow_table()
    got = QUERIES[name](spark, sf).toArrow()
    columns = want.schema.names
    assert [(f.name, str(f.type)) for f in got.schema] == [(f.name, str(f.type)) for f in want.schema]
    rows = lambda t: sorted(zip(*(t.column(c).to_pylist() for c in columns), strict=True))
    assert rows(got) == rows(want)
