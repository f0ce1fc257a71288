"""Types, units and constants shared by the whole library."""

from __future__ import annotations

import math

from pyspark.sql import types as T

#: Mean radius of the Earth in metres.
EARTH_RADIUS = 6371008.0
HALF_MERCATOR = 20037508.34
METRES_PER_DEGREE = 111319.9

POSITION = T.ArrayType(T.DoubleType())
COORDS = T.ArrayType(T.ArrayType(T.ArrayType(POSITION)))
#: Coordinates always nest like a MultiPolygon's; ``type`` tells which levels count.
GEOM = T.StructType([T.StructField("type", T.StringType()), T.StructField("coords", COORDS)])
GEOM_DDL = "struct<type:string,coords:array<array<array<array<double>>>>>"
BBOX_DDL = "struct<minx:double,miny:double,maxx:double,maxy:double>"

POINT, MULTIPOINT, LINE, MULTILINE, POLYGON, MULTIPOLYGON, COLLECTION = "Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection"

#: Metres in a unit; any other unit counts as metres.
UNITS = {
    "meters": 1.0,
    "kilometers": 1000.0,
    "miles": 1609.344,
    "nauticalmiles": 1852.0,
    "feet": 0.3048,
    "degrees": math.pi / 180 * EARTH_RADIUS,
    "radians": EARTH_RADIUS,
}


def metres(unit: str) -> float:
    return UNITS.get(unit, 1.0)


def convert_length(value, from_unit: str = "meters", to_unit: str = "kilometers"):
    """A length in another unit; works on numbers and columns alike."""
    return value * metres(from_unit) / metres(to_unit)


def angular_radians(distance, unit: str):
    """The angle at the Earth's centre that a distance spans."""
    if unit not in UNITS or unit == "degrees":
        return distance * (math.pi / 180)
    return distance * (metres(unit) / EARTH_RADIUS)


def angular_degrees(distance: float, unit: str) -> float:
    return math.degrees(angular_radians(distance, unit))
