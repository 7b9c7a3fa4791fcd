"""Pages of a stored order against pages of the sorted rows."""

from __future__ import annotations

import re

import pytest
from conftest import plan
from pyspark.sql import functions as F

from hazardlens.operators import listing
from hazardlens.plans import views
from hazardlens.sources import ranked


@pytest.fixture(scope="module")
def live(spark, small):
    return views.events(spark, small).persist()


@pytest.mark.parametrize("by", [(("time", True), ("id", False)), (("magnitude", True), ("id", True)), (("place", False), ("id", False))])
def test_every_kind_of_page(spark, live, tmp_path, by):
    stored = ranked.RankedListing.build(live, str(tmp_path / "r"), by, parts=7)
    order, n = ranked._order(by), live.count()
    for number, size in ((1, 10), (3, 17), (n // 10 + 1, 10), (2, n - 3), (1, n + 5)):
        want = [tuple(r) for r in listing.page(live, order, number, size).collect()]
        assert [tuple(r) for r in stored.page(number, size).collect()] == want
    assert stored.page(n + 1, 10).collect() == []
    assert stored.page(n + 1, 10).columns == listing.page(live, order, 1, 1).columns


def test_a_deep_page_reads_one_or_two_parts(spark, live, tmp_path):
    stored = ranked.RankedListing.build(live, str(tmp_path / "r"), (("time", True), ("id", False)), parts=10)
    parts = [r["row_count"] for r in stored.ranks().orderBy("part").collect()]
    assert len(parts) == 10 and sum(parts) == live.count()
    page = stored.page(live.count() // 5 - 3, 5)
    assert 1 <= len(page.select(F.input_file_name()).distinct().collect()) <= 2
    assert re.search(r"PartitionFilters: \[[^\]]*_part", plan(page))


def test_ties_nulls_and_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(None, 1), ("a", 1), ("a", 1), (None, 2)], "`x.y` string, n int")
    stored = ranked.RankedListing.build(rows, str(tmp_path / "r"), (("x.y", False), ("n", False)), parts=3)
    assert [tuple(r)[:2] for r in stored.page(1, 9).collect()] == [("a", 1), ("a", 1), (None, 1), (None, 2)]
    empty = ranked.RankedListing.build(rows.limit(0), str(tmp_path / "e"), (("n", False),), parts=3)
    assert empty.page(1, 5).collect() == []
    with pytest.raises(ValueError):
        stored.page(0, 5)
