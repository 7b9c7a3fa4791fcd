"""Searches of the stored index against the full scan."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from hazardlens.operators import events
from hazardlens.plans import views
from hazardlens.sources import text_index


@pytest.fixture(scope="module")
def live(spark, small):
    odd = spark.createDataFrame([("n", None), ("e", ""), ("s", "ab"), ("u", "Ünder ÉTNA 山火事"), ("d", "aaaa")], "id string, place string")
    return views.events(spark, small, 3).unionByName(odd, allowMissingColumns=True).persist()


@pytest.fixture(scope="module")
def index(spark, live, tmp_path_factory):
    return text_index.TextIndex.build(live, str(tmp_path_factory.mktemp("text")), ("place", "type"), blocks=24)


@pytest.mark.parametrize("query", ["America", "QUAKE", "city12", "étna", "山火事", "aaa", "ab", "", "fire", "no such text", "East Asia"])
def test_search_equals_the_scan(live, index, query):
    assert rows(index.search(query), "id", "place") == rows(events.event_search(live, query), "id", "place")


def test_a_rare_text_reads_few_blocks(spark, live, index):
    every = index._rows().select(text_index.BLOCK).distinct().count()
    place = live.filter("type = 'earthquake'").orderBy("place").first()["place"]
    region = live.filter("type = 'fire' AND place NOT LIKE '%°%'").groupBy("place").count().orderBy("count", "place").first()["place"]
    share = {q: len(index.blocks(q)) / every for q in (place, region, "no such text")}
    # The whole place is made of characters that most places share; the region's name is not.
    assert every >= 20 and share[place] <= 0.5 and share[region] <= 0.35 and share["no such text"] == 0
    found = index.search(region)
    assert 0 < len(found.select(F.input_file_name()).distinct().collect()) <= share[region] * every


def test_nothing_to_search(spark, live, tmp_path):
    empty = text_index.TextIndex.build(live.limit(0), str(tmp_path / "t"), ("place",), blocks=2)
    assert empty.search("abc").collect() == [] == empty.search("a").collect()
