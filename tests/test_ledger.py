"""Loads that are repeated, interrupted, late or empty."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import plan, rows

from hazardlens.sources import ledger

SCHEMA = "id string, last_modified timestamp_ntz, v int"


def day(n):
    return dt.datetime(2024, 1, n)


@pytest.fixture
def landing(spark, tmp_path):
    def land(arrived, *records):
        df = spark.createDataFrame(list(records), SCHEMA)
        df.write.mode("append").parquet(f"{tmp_path}/landed/arrived={arrived}")
        return spark.read.schema(SCHEMA + ", arrived string").parquet(f"{tmp_path}/landed")

    return land


@pytest.fixture
def table(spark, tmp_path):
    return ledger.LoadTable(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema)


def same(df):
    return df


def test_loads_count_once(table, landing):
    landed = landing("01", ("a", day(1), 1), ("b", day(2), 1), ("n", None, 1))
    assert table.rows().count() == 0 and table.ledger().count() == 0
    assert table.load("one", landed, same) and not table.load("one", landed, same)
    landed = landing("02", ("b", day(2), 2), ("c", day(2), 2), ("old", day(1), 2), ("n", None, 2), ("m", None, 2), ("d", day(3), 2), ("d", day(4), 3))
    assert table.load("two", landed, same) and not table.load("two", landed, same)
    assert rows(table.rows(), "id", "v", "load_id") == [("a", 1, "one"), ("b", 1, "one"), ("c", 2, "two"), ("d", 3, "two"), ("m", 2, "two"), ("n", 1, "one")]
    told = rows(table.ledger(), "load_id", "arrived", "mark", "row_count", "file_count")
    assert [r[:4] for r in told] == [("one", "01", day(2), 3), ("two", "02", day(4), 3)] and all(r[4] >= 1 for r in told)


def test_an_interrupted_load_is_as_if_it_had_not_been(table, landing):
    table.load("one", landing("01", ("a", day(1), 1)), same)
    landed = landing("02", ("b", day(2), 1))

    def stop():
        raise RuntimeError

    with pytest.raises(RuntimeError):
        table.load("two", landed, same, before_commit=stop)
    assert rows(table.rows(), "id") == [("a",)] and table.ledger().count() == 1
    landed = landing("03", ("c", day(3), 1))
    assert table.load("two", landed, same)  # a retry may also find more
    assert rows(table.rows(), "id") == [("a",), ("b",), ("c",)]
    assert rows(table.ledger(), "arrived") == [("01",), ("03",)]


def test_only_new_files_are_read(spark, table, landing):
    table.load("one", landing("01", ("a", day(1), 1)), same)
    landed = landing("02", ("b", day(2), 1))
    seen = []
    table.load("two", landed, lambda df: seen.append(df) or df)
    assert "PartitionFilters: [isnotnull(arrived" in plan(seen[0])
    assert all("arrived=02" in r[0] for r in seen[0].selectExpr("_metadata.file_path").distinct().collect())


def test_nothing_new_and_feeds_without_order(spark, landing, tmp_path):
    table = ledger.LoadTable(spark, str(tmp_path / "u"), spark.createDataFrame([], SCHEMA).schema, from_mark=False)
    landed = landing("01", ("a", day(5), 1))
    table.load("one", landed, same)
    assert table.load("none", landed, same)
    landed = landing("02", ("old", day(1), 1))
    table.load("two", landed, same)
    assert rows(table.rows(), "id") == [("a",), ("old",)]
    assert rows(table.ledger(), "load_id", "arrived", "mark", "row_count") == [("none", "01", day(5), 0), ("one", "01", day(5), 1), ("two", "02", day(5), 1)]
