"""A gazetteer prepared once: places by grid cell, stored so that looking points up shuffles the points alone.

``places`` holds the places bucketed by grid cell and, within a bucket, along a Z-order curve over the cells, so that places
near one another lie together in few row groups. The cells are as fine as the places ask for. A row holds the places of a cell; cells
with very many places are dealt to several parts when the index is built. ``cells`` lists the cells with their parts, ``about`` what the
index was built with; it is written last, so an index without it is not there. An index serves the radius it was built for and any smaller one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.functions.geometry import z_order
from hazardlens.operators import geo

_KEYS = ["py", "px", "part"]
_PLACES = "py int, px int, part int, places array<struct<place_id: bigint, p_lat: double, p_lon: double, city: string, country: string>>, z bigint"
_CELLS = "py int, px int, parts int"
_ABOUT = "radius_km double, buckets int, depth int"


@dataclass(frozen=True)
class PlaceIndex:
    """A stored index that points are looked up in; made by ``build`` or ``open_index``."""

    radius_km: float
    depth: int
    places: DataFrame
    cells: DataFrame

    def nearest(self, points: DataFrame, radius_km: float | None = None) -> DataFrame:
        """For each distinct point (lat_c, lon_c in hundredths of a degree) the nearest place within the radius."""
        grid = geo._Grid(self.radius_km, self.depth)
        wanted = geo.wanted_parts(geo.point_cells(points, grid), self.cells, grid)
        return geo.nearest_met(wanted.join(self.places, _KEYS), min(self.radius_km, radius_km or self.radius_km))


def build(gazetteer: DataFrame, folder: str, radius_km: float = 50.0, buckets: int = 64, part_rows: int = geo.PART_ROWS) -> PlaceIndex:
    """Write the index of a gazetteer (place_id, lat, lon, city, town, village, country) and open it."""
    spark = gazetteer.sparkSession
    distinct = geo.distinct_places(gazetteer)
    grid = geo.grid_for(distinct, radius_km)
    placed = geo.placed_cells(distinct, grid)
    geo.cells_with_parts(placed, part_rows).write.mode("overwrite").parquet(f"{folder}/cells")
    cells = spark.read.schema(_CELLS).parquet(f"{folder}/cells")
    rows = geo.packed_places(placed, cells).withColumn("z", z_order(F.col("py"), F.col("px")))
    name = f"places_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, *_KEYS)  # as the buckets are, so each is one file
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, *_KEYS).sortBy("z").option("path", f"{folder}/places").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # only the name: the folder is not the catalog's
    spark.createDataFrame([(radius_km, buckets, grid.depth)], _ABOUT).coalesce(1).write.mode("overwrite").parquet(f"{folder}/about")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> PlaceIndex:
    """A stored index, with Spark knowing the buckets of its places. The table has a name of this session and folder."""
    about = spark.read.schema(_ABOUT).parquet(f"{folder}/about").first()
    if about["depth"] is None:
        raise ValueError(f"the index in {folder} is of an older layout; build it again")
    name = f"places_{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({_PLACES}) USING parquet CLUSTERED BY ({', '.join(_KEYS)}) SORTED BY (z) INTO {about['buckets']} BUCKETS LOCATION '{folder}/places'")
    return PlaceIndex(about["radius_km"], about["depth"], spark.table(name), spark.read.schema(_CELLS).parquet(f"{folder}/cells"))
