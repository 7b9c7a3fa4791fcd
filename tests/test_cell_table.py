"""Merges of cells into a stored table: overlapping, repeated, interrupted."""

from __future__ import annotations

import random

import pytest
from conftest import plan, rows

from hazardlens.operators.cells import latest_cells
from hazardlens.sources import cell_table


def cells(spark, *records):
    return spark.createDataFrame([(k, "info", q, ts, v) for k, q, ts, v in records], cell_table._CELLS)


def test_overlapping_merges_and_a_replay(spark, tmp_path):
    rnd = random.Random(2)
    table = cell_table.CellTable(spark, str(tmp_path / "t"), slots=5, buckets=2)
    assert table.read().count() == 0
    every = None
    for i in range(3):
        batch = cells(spark, *[(f"k{rnd.randrange(30)}", rnd.choice("abc"), rnd.randrange(20), rnd.choice(["x", "y", "z"])) for _ in range(60)])
        assert table.merge(f"m{i}", batch)
        assert not table.merge(f"m{i}", cells(spark, ("other", "a", 99, "never")))
        every = batch if every is None else every.union(batch)
        assert rows(table.read()) == rows(latest_cells(every))
    assert table.merge("m0 again", every)
    assert rows(table.read()) == rows(latest_cells(every))


def test_untouched_slots_stay_where_they_are(spark, tmp_path):
    table = cell_table.CellTable(spark, str(tmp_path / "t"), slots=16, buckets=2)
    table.merge("a", cells(spark, *[(f"k{i}", "q", 1, "v") for i in range(60)]))
    before = table.generations()
    table.merge("b", cells(spark, ("k1", "q", 2, "w"), ("k1", "r", 2, "w")))
    after = table.generations()
    assert [s for s in before if before[s] != after[s]] == [r[0] for r in rows(cells(spark, ("k1", "q", 1, "")).select(table.slot().alias("s")))]
    assert table.stale() == sorted(p for s, p in before.items() if after[s] != p)
    assert not (set(table.stale()) & set(after.values()))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("stored_", "merged_"))]


def test_only_the_new_side_is_shuffled(spark, tmp_path):
    table = cell_table.CellTable(spark, str(tmp_path / "t"), slots=4, buckets=4)
    table.merge("a", cells(spark, *[(f"k{i}", "q", 1, "v") for i in range(40)]))
    out = table.merged(cells(spark, ("k1", "q", 2, "w")), table.generations(), "stored_for_plan")
    shown = plan(out)
    stored = next(part for part in shown.split("SortMergeJoin")[1].split("+- Sort") if "slot" in part and "FileScan" in part)
    spark.sql("DROP TABLE stored_for_plan")
    assert "Exchange" not in stored.split("FileScan")[0] and "Bucketed: true" in shown


def test_an_interrupted_merge_is_as_if_it_had_not_been(spark, tmp_path):
    table = cell_table.CellTable(spark, str(tmp_path / "t"), slots=2, buckets=2)
    table.merge("a", cells(spark, ("k", "q", 1, "v")))

    def stop():
        raise RuntimeError

    with pytest.raises(RuntimeError):
        table.merge("b", cells(spark, ("k", "q", 2, "w")), stop)
    assert rows(table.read(), "value") == [("v",)]
    table.merge("b", cells(spark, ("k", "q", 2, "x")))
    assert rows(table.read(), "value") == [("x",)]
