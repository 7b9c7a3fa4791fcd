from __future__ import annotations

import duckdb
import pytest

from hazardlens.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    ours = queries()[name](spark, small)
    theirs = con.execute(oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    assert sorted(map(tuple, ours.select(*names).collect())) == sorted(theirs.fetchall())
