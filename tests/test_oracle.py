"""Every registered query against its SQL in DuckDB, whole tables, exact values."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as contract
from hazardlens.plans import oracles
from hazardlens.plans import queries as registered

TABLES = [p.stem for p in Path("/root/testdata/sf0.001").glob("*.parquet")]


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def _plain(value):
    if pd.isna(value):
        return None
    if isinstance(value, (bool, np.bool_, str)):
        return str(value)
    if isinstance(value, (int, float, np.integer, np.floating)):
        return repr(float(value))
    return str(pd.Timestamp(value)) if isinstance(value, (pd.Timestamp, np.datetime64)) else str(value)


def _table(df: pd.DataFrame):
    names = sorted(df.columns)
    body = [tuple(_plain(v) for v in r) for r in df[names].astype(object).itertuples(index=False, name=None)]
    return names, sorted(body, key=lambda r: tuple((v is None, v or "") for v in r))


def test_every_query_has_an_oracle():
    assert set(oracles.oracle_sql()) == set(registered.queries()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(registered.queries()))
def test_query_equals_oracle(spark, duck, small, name):
    ours = contract.queries()[name](spark, small).toPandas()
    theirs = duck.execute(contract.oracle_sql()[name]).df()
    for c in ours.columns:  # DATE arrives as datetime64 from one side and as date from the other
        if str(ours[c].dtype) == "object" and len(ours) and type(ours[c].iloc[0]).__name__ == "date":
            ours[c] = pd.to_datetime(ours[c])
    assert len(theirs) > 0
    assert _table(ours) == _table(theirs)


def test_entry_runs(spark):
    assert contract.entry(spark).limit(1).count() == 1
