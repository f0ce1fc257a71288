"""SQL functions: operators by name in ``spark.sql``.

The point operators, lengths and boxes are temporary SQL functions, so Catalyst inlines
them like the Column functions. What a kernel does is an Arrow function.
"""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from meridia.functions.kernels import arrow_function
from meridia.kernels import overlay, planar
from meridia.schema import EARTH_RADIUS, GEOM_DDL, HALF_MERCATOR

_XY = "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
_HALF = "power(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * power(sin(radians(x2 - x1) / 2), 2)"
_D = f"(d / {EARTH_RADIUS})"
_LAT = f"asin(greatest(-1D, least(1D, sin(radians(y)) * cos{_D} + cos(radians(y)) * sin{_D} * cos(radians(bearing)))))"

_E = "power(sin(radians(e.b[1] - e.a[1]) / 2), 2) + cos(radians(e.a[1])) * cos(radians(e.b[1])) * power(sin(radians(e.b[0] - e.a[0]) / 2), 2)"
_LENGTH = f"{2 * EARTH_RADIUS}D * atan2(sqrt({_E}), sqrt(greatest(1D - ({_E}), 0D)))"

FUNCTIONS = {
    "geo_haversine": (_XY, "DOUBLE", f"{2 * EARTH_RADIUS}D * atan2(sqrt({_HALF}), sqrt(greatest(1D - ({_HALF}), 0D)))"),
    "geo_planar_distance": (_XY, "DOUBLE", "hypot(x2 - x1, y2 - y1)"),
    "geo_bearing": (_XY, "DOUBLE", "(degrees(atan2(sin(radians(x2 - x1)) * cos(radians(y2)), cos(radians(y1)) * sin(radians(y2)) - sin(radians(y1)) * cos(radians(y2)) * cos(radians(x2 - x1)))) + 360) % 360"),
    "geo_destination_lat": ("x DOUBLE, y DOUBLE, d DOUBLE, bearing DOUBLE", "DOUBLE", f"degrees({_LAT})"),
    "geo_destination_lng": ("x DOUBLE, y DOUBLE, d DOUBLE, bearing DOUBLE", "DOUBLE", f"degrees((radians(x) + atan2(sin(radians(bearing)) * sin{_D} * cos(radians(y)), cos{_D} - sin(radians(y)) * sin({_LAT})) + pi()) % (2 * pi()) - pi())"),
    "geo_mercator_x": ("x DOUBLE", "DOUBLE", f"x * {HALF_MERCATOR / 180}D"),
    "geo_mercator_y": ("y DOUBLE", "DOUBLE", f"ln(tan(pi() / 4 + y * pi() / 360)) * {HALF_MERCATOR / math.pi}D"),
    "geo_box_distance": ("x DOUBLE, y DOUBLE, minx DOUBLE, miny DOUBLE, maxx DOUBLE, maxy DOUBLE", "DOUBLE", "hypot(greatest(minx - x, 0D, x - maxx), greatest(miny - y, 0D, y - maxy))"),
    # Along all paths, in metres: the column function's mode="corrected".
    "geo_length": (f"g {GEOM_DDL}", "DOUBLE", "CASE WHEN g.type = 'Point' THEN 0D ELSE aggregate(flatten(g.coords), 0D, (all, r) -> all + aggregate(zip_with(slice(r, 1, greatest(size(r) - 1, 0)), slice(r, 2, greatest(size(r) - 1, 0)), (a, b) -> struct(a, b)), 0D, (sum, e) -> sum + " + _LENGTH + ")) END"),
    "geo_min_x": (f"g {GEOM_DDL}", "DOUBLE", "array_min(transform(flatten(flatten(g.coords)), p -> p[0]))"),
    "geo_min_y": (f"g {GEOM_DDL}", "DOUBLE", "array_min(transform(flatten(flatten(g.coords)), p -> p[1]))"),
    "geo_max_x": (f"g {GEOM_DDL}", "DOUBLE", "array_max(transform(flatten(flatten(g.coords)), p -> p[0]))"),
    "geo_max_y": (f"g {GEOM_DDL}", "DOUBLE", "array_max(transform(flatten(flatten(g.coords)), p -> p[1]))"),
}

KERNELS = {
    "geo_union": (lambda a, b: overlay.combine(a, b, "union"), GEOM_DDL),
    "geo_intersection": (lambda a, b: overlay.combine(a, b, "intersect"), GEOM_DDL),
    "geo_difference": (lambda a, b: overlay.combine(a, b, "difference"), GEOM_DDL),
    "geo_xor": (lambda a, b: overlay.combine(a, b, "xor"), GEOM_DDL),
    "geo_buffer": (lambda g, km: planar.buffer(g, km, "kilometers", 16, "reference"), GEOM_DDL),
    "geo_simplify": (planar.simplify, GEOM_DDL),
    "geo_clip": (lambda g, x0, y0, x1, y1: planar.box_clip(g, [x0, y0, x1, y1], "corrected"), GEOM_DDL),
    "geo_chunks": (lambda g, metres: planar.chunks(g, metres, False), f"array<{GEOM_DDL}>"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; returns their names."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    for name, (f, ddl) in KERNELS.items():
        spark.udf.register(name, arrow_function(f, ddl))
    return [*FUNCTIONS, *KERNELS]
