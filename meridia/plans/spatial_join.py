"""Spatial joins planned as equi-joins.

Catalyst can't turn "point in polygon" into a hash join, so it is done here: polygons
are dealt to the grid cells that their boxes touch, points to the one cell they are in,
and the exact test refines what meets in a cell. A polygon that would touch more than
``MAX_CELLS`` cells goes to coarser cells, at a level of its own, and every point is dealt
to one cell of each level in use, so nothing is dropped and nothing blows up. When the
polygon table is small (by its size, not by trust) it is broadcast instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions import predicates as Q

MAX_CELLS = 64
LEVELS = 16
BROADCAST_BYTES = 8 << 20
TOUCH = 1e-6


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's bound on a table's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _cells(lo_x: Column, lo_y: Column, hi_x: Column, hi_y: Column, level: Column, size: float) -> Column:
    """The cells of a level that a box touches."""
    step = F.lit(size) * F.pow(F.lit(2.0), level)
    at = lambda v: F.floor(v / step).cast("long")
    xs, ys = F.sequence(at(lo_x), at(hi_x)), F.sequence(at(lo_y), at(hi_y))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(level.cast("int").alias("level"), x.alias("cx"), y.alias("cy")))))


def _level(width: Column, height: Column, size: float) -> Column:
    """The finest level at which a box touches no more than about ``MAX_CELLS`` cells."""
    span = F.greatest(width, height) / F.lit(size * (math.isqrt(MAX_CELLS) - 1))
    return F.when(span > 1, F.least(F.lit(LEVELS), F.ceil(F.log2(span)).cast("int"))).otherwise(F.lit(0))


def point_polygon_pairs(points: DataFrame, polygons: DataFrame, cell: float = 1.0, strategy: str = "auto", how: str = "inner", mode: str = "reference") -> DataFrame:
    """All (points.*, polygons.*) whose point is in the polygon.

    ``points`` has lng and lat, ``polygons`` geom; other column names must differ.
    strategy: "broadcast", "cells", or "auto", which broadcasts polygons of no more than
    ``BROADCAST_BYTES`` by the optimizer's bound. how="left" keeps points without a polygon;
    dealt to cells, a point then has a row for every level without one. A point within 1e-10
    of an edge counts as on it; mode="corrected" takes coordinates as they stand.
    """
    boxed = polygons.withColumn("_box", G.bbox("geom"))
    inside = (Q.xy_in_polygon_exact if mode == "corrected" else Q.xy_in_polygon)(F.col("lng"), F.col("lat"), "geom")
    in_box = (F.col("lng") >= F.col("_box.minx") - TOUCH) & (F.col("lng") <= F.col("_box.maxx") + TOUCH) & (F.col("lat") >= F.col("_box.miny") - TOUCH) & (F.col("lat") <= F.col("_box.maxy") + TOUCH)
    good = F.when(in_box, inside).otherwise(F.lit(False))
    if strategy == "broadcast" or strategy == "auto" and plan_bytes(polygons) <= BROADCAST_BYTES:
        return points.join(F.broadcast(boxed), good, how).drop("_box")
    level = _level(F.col("_box.maxx") - F.col("_box.minx"), F.col("_box.maxy") - F.col("_box.miny"), cell)
    dealt = boxed.withColumn("_at", F.explode(_cells(F.col("_box.minx") - TOUCH, F.col("_box.miny") - TOUCH, F.col("_box.maxx") + TOUCH, F.col("_box.maxy") + TOUCH, level, cell)))
    levels = sorted(r.level for r in boxed.select(level.alias("level")).distinct().collect()) or [0]  # LEVELS + 1 at most
    spots = F.array(*(F.struct(F.lit(k).alias("level"), *(F.floor(F.col(c) / F.lit(cell * 2.0**k)).cast("long").alias(n) for c, n in (("lng", "cx"), ("lat", "cy")))) for k in levels))
    spread = points.withColumn("_cell", F.explode(spots))
    return spread.join(dealt, (F.col("_cell") == F.col("_at")) & good, how).drop("_cell", "_at", "_box")


def near_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """All pairs of points (x, y, and left's and right's other columns, whose names must
    differ: right has rx and ry) within a planar distance, with the distance ``d``."""
    at = lambda c: F.floor(F.col(c) / F.lit(radius)).cast("long")
    around = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    spread = right.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).withColumn("_cx", at("rx") + F.col("_dx")).withColumn("_cy", at("ry") + F.col("_dy")).drop("_dx", "_dy")
    own = left.withColumn("_cx", at("x")).withColumn("_cy", at("y"))
    pairs = own.join(spread, ["_cx", "_cy"]).withColumn("d", F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry")))
    return pairs.filter(F.col("d") <= radius).drop("_cx", "_cy")
