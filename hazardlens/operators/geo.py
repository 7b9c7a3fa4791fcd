"""Places, regions and map operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlens import params
from hazardlens.functions import geometry, places
from hazardlens.functions.grading import grade
from hazardlens.functions.numbers import round_to
from hazardlens.operators.events import event_value
from hazardlens.operators.skew import hot_keys, salted_join

FINE_PER_COARSE = 8
#: Places that share a cell, as the average place sees it, above which cells are halved, and how often at most.
CROWD = 16
MOST_DEPTH = 8
#: Places of one cell in one part.
PART_ROWS = 256
_SLACK_KM = 2e-6  # distances are compared rounded to 1e-6
_PLACE = ["place_id", "p_lat", "p_lon", "city", "country"]


class _Grid:
    """Coarse cells at least as wide as the search radius, and fine cells that split them, halved ``depth`` times more."""

    def __init__(self, radius_km: float, depth: int = 0):
        self.radius, self.depth = radius_km, depth
        self.per_coarse = FINE_PER_COARSE << depth
        self.coarse_ring = max(1, math.floor(360 * geometry.KM_PER_DEGREE / radius_km))
        self.coarse = 360 / self.coarse_ring
        self.fine = self.coarse / self.per_coarse
        self.fine_ring = self.coarse_ring * self.per_coarse

    def fine_y(self, lat: Column) -> Column:
        return F.floor((lat + F.lit(90.0)) / F.lit(self.fine)).cast("int")

    def fine_x(self, lon: Column) -> Column:
        return F.pmod(F.floor((lon + F.lit(180.0)) / F.lit(self.fine)), F.lit(self.fine_ring)).cast("int")

    def coarse_of(self, index: Column) -> Column:
        return F.floor(index / F.lit(self.per_coarse)).cast("int")

    def edges(self, y: Column) -> tuple[Column, Column]:
        south = F.greatest(F.lit(-90.0), y * F.lit(self.fine) - F.lit(90.0))
        north = F.least(F.lit(90.0), (y + 1) * F.lit(self.fine) - F.lit(90.0))
        return south, north

    def cos_range(self, y: Column) -> tuple[Column, Column]:
        south, north = self.edges(y)
        a, b = F.cos(F.radians(south)), F.cos(F.radians(north))
        return F.least(a, b), F.when((south <= 0) & (north >= 0), F.lit(1.0)).otherwise(F.greatest(a, b))

    def coarse_columns_around(self, y: Column, x: Column) -> Column:
        """Coarse columns that can hold a point within the radius of fine cell (y, x)."""
        south, north = self.edges(y)
        top = F.greatest(F.abs(south), F.abs(north)) + F.lit(self.coarse)
        narrow = F.cos(F.radians(F.least(F.lit(90.0), top)))
        reach = F.lit(math.sin(min(math.pi / 2, self.radius / (2 * params.EARTH_RADIUS_KM))))
        spread = F.when(narrow <= reach, F.lit(180.0)).otherwise(F.degrees(2 * F.asin(reach / narrow)))
        half = F.least(F.ceil(spread / F.lit(self.coarse)), F.lit(self.coarse_ring)).cast("int")
        mid = self.coarse_of(x)
        return F.when(
            2 * half + 1 >= self.coarse_ring, F.sequence(F.lit(0), F.lit(self.coarse_ring - 1))
        ).otherwise(F.transform(F.sequence(mid - half, mid + half), lambda i: F.pmod(i, F.lit(self.coarse_ring))))

    def distance_bounds(self, y1: Column, x1: Column, y2: Column, x2: Column) -> tuple[Column, Column]:
        """Least and greatest distance in km between points of two fine cells."""
        dy = F.abs(y1 - y2)
        dx = F.least(F.abs(x1 - x2), F.lit(self.fine_ring) - F.abs(x1 - x2))
        min1, max1 = self.cos_range(y1)
        min2, max2 = self.cos_range(y2)
        fine = F.lit(self.fine)
        low = _arc(F.greatest(dy - 1, F.lit(0)) * fine, F.greatest(dx - 1, F.lit(0)) * fine, min1 * min2)
        high = _arc((dy + 1) * fine, F.least((dx + 1) * fine, F.lit(180.0)), max1 * max2)
        return low, high

    def box(self, y: Column, x: Column) -> list[Column]:
        """What ``distances_to_box`` needs of a fine cell."""
        (south, north), (least, most) = self.edges(y), self.cos_range(y)
        west = x * F.lit(self.fine) - F.lit(180.0)
        return [south.alias("south"), north.alias("north"), west.alias("west"), least.alias("cos_least"), most.alias("cos_most")]

    def distances_to_box(self, lat: Column, lon: Column, box: Column) -> tuple[Column, Column]:
        """Least and greatest distance in km, or less and more, between a point and the points of a fine cell."""
        below, above = box["south"] - lat, lat - box["north"]
        east = F.pmod(lon - box["west"], F.lit(360.0))
        dlon = F.when(east <= F.lit(self.fine), F.lit(0.0)).otherwise(F.least(east - F.lit(self.fine), F.lit(360.0) - east))
        own = F.cos(F.radians(lat))
        low = _arc(F.greatest(below, above, F.lit(0.0)), dlon, own * box["cos_least"])
        high = _arc(F.greatest(F.abs(below), F.abs(above)), F.least(dlon + F.lit(self.fine), F.lit(180.0)), own * box["cos_most"])
        return low, high


def _arc(dlat: Column, dlon: Column, cosines: Column) -> Column:
    h = F.pow(F.sin(F.radians(dlat) / 2), F.lit(2.0)) + cosines * F.pow(F.sin(F.radians(dlon) / 2), F.lit(2.0))
    return F.lit(2 * params.EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def distinct_places(gazetteer: DataFrame) -> DataFrame:
    """The places of a gazetteer with their names; of those at one coordinate the one that wins every tie."""
    named = gazetteer.filter("lat IS NOT NULL AND lon IS NOT NULL").select(
        F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"),
        F.struct(
            "place_id", F.coalesce("city", "town", "village", F.lit(places.UNKNOWN)).alias("city"),
            F.coalesce("country", F.lit(places.UNKNOWN)).alias("country"),
        ).alias("place"),
    )
    return named.groupBy("p_lat", "p_lon").agg(F.min("place").alias("place")).select("p_lat", "p_lon", "place.*")


def placed_cells(distinct: DataFrame, grid: _Grid) -> DataFrame:
    """Places with the fine cell (py, px) that each lies in."""
    return distinct.select(*_PLACE, grid.fine_y(F.col("p_lat")).alias("py"), grid.fine_x(F.col("p_lon")).alias("px"))


def grid_for(distinct: DataFrame, radius_km: float) -> _Grid:
    """The grid whose cells the places do not crowd: the sum of squares of the cells' counts tells what the average place
    sees. One small row for each depth comes to the driver."""
    deepest = placed_cells(distinct, _Grid(radius_km, MOST_DEPTH)).groupBy("py", "px").agg(F.count("*").alias("n"))
    up = F.col("depth") - F.lit(MOST_DEPTH)
    every = deepest.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(MOST_DEPTH)))).groupBy(
        "depth", F.call_function("shiftright", "py", -up).alias("y"), F.call_function("shiftright", "px", -up).alias("x")
    )
    n = F.col("n").cast("double")
    crowds = every.agg(F.sum("n").alias("n")).groupBy("depth").agg((F.sum(n * n) / F.sum(n)).alias("crowd")).collect()
    return _Grid(radius_km, min((r["depth"] for r in crowds if r["crowd"] <= CROWD), default=MOST_DEPTH if crowds else 0))


def cells_with_parts(placed: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(py, px, parts): the cells that hold places, and to how many parts these are dealt."""
    return placed.groupBy("py", "px").agg(F.ceil(F.count("*") / F.lit(part_rows)).cast("int").alias("parts"))


def packed_places(placed: DataFrame, cells: DataFrame) -> DataFrame:
    """(py, px, part, places): the places of a part as one row."""
    part = F.pmod(F.xxhash64("place_id", "p_lat", "p_lon"), F.col("parts")).cast("int")
    dealt = placed.join(cells, ["py", "px"]).withColumn("part", part)
    return dealt.groupBy("py", "px", "part").agg(F.collect_list(F.struct(*_PLACE)).alias("places"))


def _degrees() -> tuple[Column, Column]:
    return F.col("lat_c") / F.lit(100.0), F.col("lon_c") / F.lit(100.0)


def point_cells(points: DataFrame, grid: _Grid) -> DataFrame:
    """Points (lat_c, lon_c in hundredths of a degree) with their fine cell (ey, ex)."""
    lat, lon = _degrees()
    return points.select("lat_c", "lon_c", grid.fine_y(lat).alias("ey"), grid.fine_x(lon).alias("ex"))


def _possible(pairs: DataFrame, grid: _Grid) -> DataFrame:
    """The cell pairs (ey, ex, py, px) that may hold a point and its nearest place."""
    low, high = grid.distance_bounds(F.col("ey"), F.col("ex"), F.col("py"), F.col("px"))
    near = pairs.select("ey", "ex", "py", "px", low.alias("low"), high.alias("high")).filter(F.col("low") <= F.lit(grid.radius + _SLACK_KM))
    least = F.min("high").over(Window.partitionBy("ey", "ex"))
    return near.withColumn("least", least).filter(F.col("low") <= F.col("least") + F.lit(_SLACK_KM)).select("ey", "ex", "py", "px")


def cells_in_reach(pts: DataFrame, place_cells: DataFrame, grid: _Grid) -> DataFrame:
    """(ey, ex, py, px): for each point cell the place cells that can hold the nearest place.

    Cells are compared before points: a place cell stays a candidate of a point cell only if its
    least distance does not exceed the smallest greatest distance to any place cell. The widest
    cells are compared first and only the halves of what remains after them, so the pairs of a
    point cell stay few however fine the grid is.
    """
    def cells_at(cells: DataFrame, names: tuple[str, str], depth: int) -> DataFrame:
        return cells.select(*[F.shiftright(c, grid.depth - depth).alias(c) for c in names]).distinct()

    first = _Grid(grid.radius)
    around = (
        cells_at(pts, ("ey", "ex"), 0)
        .withColumn("cx", F.explode(first.coarse_columns_around(F.col("ey"), F.col("ex"))))
        .withColumn("cy", F.explode(F.sequence(first.coarse_of(F.col("ey")) - 1, first.coarse_of(F.col("ey")) + 1)))
    )
    indexed = cells_at(place_cells, ("py", "px"), 0).withColumns({"cx": first.coarse_of(F.col("px")), "cy": first.coarse_of(F.col("py"))})
    pairs = _possible(around.join(indexed, ["cy", "cx"]), first)
    for depth in range(1, grid.depth + 1):
        halves = pairs.toDF("_ey", "_ex", "_py", "_px")
        for names in (("ey", "ex"), ("py", "px")):
            cells = cells_at(pts if names[0] == "ey" else place_cells, names, depth)
            halves = halves.join(cells.withColumns({f"_{c}": F.shiftright(c, 1) for c in names}), [f"_{c}" for c in names])
        pairs = _possible(halves, _Grid(grid.radius, depth))
    return pairs


def wanted_parts(pts: DataFrame, cells: DataFrame, grid: _Grid) -> DataFrame:
    """(lat_c, lon_c, py, px, part): the parts in which a point's nearest place can be, by the point's own distances to the
    cells that its cell has in reach."""
    reach = cells_in_reach(pts, cells.select("py", "px"), grid).join(cells, ["py", "px"])
    box = F.struct("py", "px", "parts", *grid.box(F.col("py"), F.col("px")))
    around = reach.groupBy("ey", "ex").agg(F.collect_list(box).alias("boxes"))

    def measured(c: Column) -> Column:
        low, high = grid.distances_to_box(*_degrees(), c)
        return F.struct(c["py"].alias("py"), c["px"].alias("px"), c["parts"].alias("parts"), low.alias("low"), high.alias("high"))

    near = pts.join(around, ["ey", "ex"]).select("lat_c", "lon_c", F.transform("boxes", measured).alias("boxes"))
    near = near.withColumn("least", F.array_min(F.transform("boxes", lambda c: c["high"])))
    near = near.select("lat_c", "lon_c", F.inline(F.filter("boxes", lambda c: c["low"] <= F.col("least") + F.lit(_SLACK_KM))))
    return near.select("lat_c", "lon_c", "py", "px", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def nearest_met(met: DataFrame, radius_km: float) -> DataFrame:
    """The nearest place of each point among the ``places`` of the parts it has met; ties go to the smaller place_id."""
    def near(p: Column) -> Column:
        km = geometry.haversine_km(*_degrees(), p["p_lat"], p["p_lon"])
        return F.struct(round_to(km, 6).alias("km"), p["place_id"].alias("place_id"), p["city"].alias("city"), p["country"].alias("country"))

    return (
        met.select("lat_c", "lon_c", F.array_min(F.transform("places", near)).alias("near"))
        .filter(F.col("near.km") <= radius_km)
        .groupBy("lat_c", "lon_c")
        .agg(F.min("near").alias("near"))
    )


def nearest_places(points: DataFrame, gazetteer: DataFrame, radius_km: float) -> DataFrame:
    """For each distinct point (lat_c, lon_c in hundredths of a degree) the nearest place within the radius."""
    distinct = distinct_places(gazetteer)
    grid = grid_for(distinct, radius_km)
    placed = placed_cells(distinct, grid)
    cells = cells_with_parts(placed)
    wanted = wanted_parts(point_cells(points, grid), cells, grid)
    return nearest_met(wanted.join(packed_places(placed, cells), ["py", "px", "part"]), radius_km)


def reverse_geocode(events: DataFrame, gazetteer, radius_km: float = 50.0, keep_given: bool = True) -> DataFrame:
    """Add place_id, city, country and distance of the nearest place to every event.

    ``gazetteer`` is a table of places, or a ``place_index.PlaceIndex``, built once for its own radius.

    Coordinates are rounded to 2 decimals and looked up once each; the way back to the events
    spreads a coordinate shared by very many events. Without a place in reach the texts are
    Unknown. With ``keep_given`` only missing city and country values are filled.
    """
    def hundredths(name: str) -> Column:
        return F.floor(F.col(name) * F.lit(100.0) + F.lit(0.5)).cast("bigint")

    keyed = events.withColumns({"lat_c": hundredths("latitude"), "lon_c": hundredths("longitude")})
    points = keyed.groupBy("lat_c", "lon_c").agg(F.count("*").alias("rows"))
    known = points.filter(F.col("lat_c").isNotNull() & F.col("lon_c").isNotNull())
    near = nearest_places(known, gazetteer, radius_km) if isinstance(gazetteer, DataFrame) else gazetteer.nearest(known)
    found = salted_join(keyed, near, ["lat_c", "lon_c"], hot_keys(known, ["lat_c", "lon_c"]), "left")

    def filled(name: str) -> Column:
        given = [F.col(name)] if keep_given and name in events.columns else []
        return F.coalesce(*given, F.col(f"near.{name}"), F.lit(places.UNKNOWN))

    return found.withColumns(
        {
            "city": filled("city"),
            "country": filled("country"),
            "place_id": F.col("near.place_id"),
            "distance_km": round_to(F.col("near.km"), 3),
        }
    ).drop("near", "lat_c", "lon_c")


def merge_colocated(events: DataFrame, quake_grades=None, fire_grades=None) -> DataFrame:
    """Merge events that share a coordinate (6 decimals) per type.

    A coordinate with one event passes it through. Otherwise each type keeps its row with the
    largest value (then the newest, then the smallest id) under a merged id, graded again, with
    the count in the place text. One combining aggregate does it, then a window over at most one
    row per type.
    """
    lat, lon = geometry.coordinate_key(F.col("latitude")), geometry.coordinate_key(F.col("longitude"))
    value = F.coalesce(event_value(), F.lit(0.0))
    age = F.timestamp_diff("MICROSECOND", F.col("time").cast("timestamp_ntz"), F.expr("TIMESTAMP_NTZ'2100-01-01 00:00:00'"))
    payload = F.struct("time", "latitude", "longitude", "place", "severity", "magnitude", "frp")
    top = F.min(F.struct((-value).alias("rank"), age.alias("age"), "id", payload.alias("row"))).alias("top")
    per_type = events.groupBy(lat.alias("lat_key"), lon.alias("lon_key"), "type").agg(F.count("*").alias("n"), top)
    sized = per_type.withColumn("here", F.sum("n").over(Window.partitionBy("lat_key", "lon_key")))
    merged = F.col("here") > 1
    quake = F.col("type") == "earthquake"
    best = -F.col("top.rank")
    regraded = F.when(quake, grade(best, quake_grades or params.QUAKE_GRADES_3)).otherwise(
        grade(best, fire_grades or params.FIRE_GRADES_3)
    )
    noun = F.when(quake, F.lit(" earthquakes)")).otherwise(F.lit(" fires)"))
    coord = F.concat_ws("_", F.col("lat_key").cast("string"), F.col("lon_key").cast("string"))
    return sized.select(
        F.when(merged, F.concat_ws("_", F.lit("merged"), "type", coord, F.col("n").cast("string")))
        .otherwise(F.col("top.id")).alias("id"),
        "type", "top.row.time", "top.row.latitude", "top.row.longitude",
        F.when(F.col("n") > 1, F.concat("top.row.place", F.lit(" ("), F.col("n").cast("string"), noun))
        .otherwise(F.col("top.row.place")).alias("place"),
        F.when(merged, regraded).otherwise(F.col("top.row.severity")).alias("severity"),
        F.when(merged & quake, best).otherwise(F.col("top.row.magnitude")).alias("magnitude"),
        F.when(merged & ~quake, best).otherwise(F.col("top.row.frp")).alias("frp"),
        F.col("n").alias("merged_count"),
    )


def resolve_ids(events: DataFrame, ids: DataFrame) -> DataFrame:
    """The event behind each wanted id; a merged id gives the newest event of its type and coordinate.

    ``ids`` has one column ``wanted_id``. Events are first reduced to the wanted ones, then to one row per key by a combining aggregate, so neither a
    repeated id nor a crowded coordinate fans out.
    """
    wanted = ids.select("wanted_id").distinct()
    form = "^merged_(.+)_([^_]+_[^_]+)_[^_]+$"  # a type may hold underscores itself
    merged_ids = wanted.filter(F.col("wanted_id").rlike(form)).select(
        "wanted_id", F.regexp_extract("wanted_id", form, 1).alias("type"), F.regexp_extract("wanted_id", form, 2).alias("coord"),
    )
    newest = F.max(F.struct("time", "id", "type")).alias("newest")
    narrow = events.select("id", "type", "time", "latitude", "longitude")
    direct = (
        narrow.withColumn("wanted_id", F.col("id")).join(wanted, "wanted_id", "left_semi")
        .groupBy("wanted_id").agg(newest)
        .select("wanted_id", "newest.id", "newest.type", "newest.time")
    )
    by_coord = (
        narrow.withColumn("coord", geometry.coordinate_text(F.col("latitude"), F.col("longitude")))
        .join(merged_ids, ["type", "coord"], "left_semi")
        .groupBy("type", "coord").agg(newest)
    )
    via_coord = merged_ids.join(by_coord, ["type", "coord"]).select("wanted_id", "newest.id", "newest.type", "newest.time")
    return direct.unionByName(via_coord.join(direct.select("wanted_id"), "wanted_id", "left_anti"))


def mercator_grid(
    events: DataFrame,
    zoom: float = 2.0,
    center_lat: float = 0.0,
    center_lon: float = 0.0,
    width: int = 800,
    height: int = 600,
    cell: int = 30,
    levels=("low", "moderate", "high"),
) -> DataFrame:
    """Events per pixel cell of a Web-Mercator map, with the highest severity in it."""
    x, y = geometry.mercator_pixel(
        F.col("latitude"), F.col("longitude"), zoom, center_lat, center_lon, width, height
    )
    rank = F.coalesce(*[F.when(F.col("severity") == s, F.lit(i)) for i, s in enumerate(levels)], F.lit(-1))
    cells = (
        events.select(geometry.snap(x, cell).alias("cell_x"), geometry.snap(y, cell).alias("cell_y"), rank.alias("rank"))
        .groupBy("cell_x", "cell_y")
        .agg(F.count("*").alias("event_count"), F.max("rank").alias("rank"))
    )
    name = F.coalesce(*[F.when(F.col("rank") == i, F.lit(s)) for i, s in enumerate(levels)], F.lit(params.UNKNOWN_GRADE))
    return cells.select("cell_x", "cell_y", "event_count", name.alias("max_severity"))


def tile_pyramid(events: DataFrame, zoom: int = 10, levels=("low", "moderate", "high")) -> DataFrame:
    """Events and highest severity of every tile that has any, for all zooms from 0 to ``zoom``.

    Events are counted once, by the tiles of the deepest zoom; these are numbered along a Z-order curve, where a prefix is the
    tile of a higher zoom, so every other zoom is summed up from them: one scan, one shuffle of tiles, one of prefixes.
    Events without a coordinate are in no tile.
    """
    rank = F.coalesce(*[F.when(F.col("severity") == s, F.lit(i)) for i, s in enumerate(levels)], F.lit(-1))
    x, y = geometry.mercator_tile(F.col("latitude"), F.col("longitude"), zoom)
    deepest = (
        events.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
        .select(geometry.z_order(y, x, max(1, zoom)).alias("z"), rank.alias("rank"))
        .groupBy("z").agg(F.count("*").alias("event_count"), F.max("rank").alias("rank"))
    )
    prefixes = F.array(*[F.struct(F.lit(k).alias("zoom"), F.shiftright("z", 2 * (zoom - k)).alias("prefix")) for k in range(zoom + 1)])
    tiles = deepest.select(F.inline(prefixes), "event_count", "rank").groupBy("zoom", "prefix")
    sums = tiles.agg(F.sum("event_count").alias("event_count"), F.max("rank").alias("rank"))
    row, column = geometry.from_z_order(F.col("prefix"), max(1, zoom))
    name = F.coalesce(*[F.when(F.col("rank") == i, F.lit(s)) for i, s in enumerate(levels)], F.lit(params.UNKNOWN_GRADE))
    return sums.select("zoom", column.alias("tile_x"), row.alias("tile_y"), "event_count", name.alias("max_severity"))
