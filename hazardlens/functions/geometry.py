"""Distances, grid cells and the Mercator projection as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardlens import params

KM_PER_DEGREE = math.pi * params.EARTH_RADIUS_KM / 180


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_dlon), F.lit(2.0)
    )
    return F.lit(2 * params.EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def coordinate_key(value: Column) -> Column:
    """A coordinate at 6 decimals as a compact exact group key."""
    return value.cast("decimal(9,6)")


def coordinate_text(lat: Column, lon: Column) -> Column:
    return F.concat_ws("_", coordinate_key(lat).cast("string"), coordinate_key(lon).cast("string"))


def mercator_pixel(
    lat: Column, lon: Column, zoom: float, center_lat: float, center_lon: float, width: int, height: int
) -> tuple[Column, Column]:
    """Pixel position of a point on a Web-Mercator canvas."""
    scale = 2.0**zoom * 256 / (2 * math.pi)
    y0 = math.log(math.tan(math.pi / 4 + math.radians(center_lat) / 2))
    x = F.lit(width / 2) + (F.radians(lon) - F.lit(math.radians(center_lon))) * F.lit(scale)
    north = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
    y = F.lit(height / 2) - (north - F.lit(y0)) * F.lit(scale)
    return x, y


def snap(value: Column, step: int) -> Column:
    """Nearest multiple of ``step`` with halves rounded up."""
    return (F.floor(value / F.lit(float(step)) + F.lit(0.5)) * F.lit(step)).cast("bigint")


def z_order(y: Column, x: Column, bits: int = 16) -> Column:
    """The bits of two small numbers in turn: near cells have near numbers, and a prefix is a cell of a coarser grid."""
    out = F.lit(0).cast("bigint")
    for i in range(bits):
        for k, v in enumerate((x, y)):
            bit = F.shiftright(v, i).bitwiseAND(1).cast("bigint")
            out = out.bitwiseOR(F.shiftleft(bit, 2 * i + k))
    return out


def from_z_order(z: Column, bits: int = 16) -> tuple[Column, Column]:
    """The two numbers (y, x) of a ``z_order``."""
    out = []
    for k in (1, 0):
        v = F.lit(0)
        for i in range(bits):
            v = v.bitwiseOR(F.shiftleft(F.shiftright(z, 2 * i + k).bitwiseAND(1).cast("int"), i))
        out.append(v)
    return out[0], out[1]


def mercator_tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the Web-Mercator tile of a point; latitudes beyond the map lie in its outermost rows."""
    n = float(2**zoom)
    known = F.least(F.greatest(lat, F.lit(-89.0)), F.lit(89.0))
    north = F.log(F.tan(F.lit(math.pi / 4) + F.radians(known) / 2)) / F.lit(math.pi)
    whole = lambda v: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(2**zoom - 1)).cast("int")
    return whole((lon + 180.0) / 360.0 * n), whole((1.0 - north) / 2.0 * n)
