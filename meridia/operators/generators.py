"""Table functions: grids, random features, and one row per part, vertex or segment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions import lines as L
from meridia.schema import convert_length

WORLD = (-180.0, -90.0, 180.0, 90.0)


def _box(box) -> tuple[float, float, float, float]:
    if len(box) < 4:
        raise ValueError("a box has four numbers")
    return tuple(float(v) for v in box[:4])


def _side(side: float, unit: str, y1: float, y2: float, least: float = 0.001) -> float:
    """A side in degrees, stretched by the latitude in the middle."""
    cos = math.cos(math.radians((y1 + y2) / 2))
    return convert_length(side, unit, "degrees") / cos or least if cos else least


def _steps(lo: float, hi: float, side: float, closed: bool) -> int:
    """How many of lo, lo + side, ... are below hi, or up to it."""
    n = (hi - lo) / side
    return max(0, math.floor(n + 1e-9) + 1 if closed else math.ceil(n - 1e-9))


def lattice(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """(fid, i, j), x-major, as one distributed range."""
    return spark.range(nx * ny).select(F.col("id").alias("fid"), F.floor(F.col("id") / F.lit(ny)).cast("long").alias("i"), (F.col("id") % F.lit(ny)).alias("j")) if nx * ny else spark.range(0).select(F.col("id").alias("fid"), F.col("id").alias("i"), F.col("id").alias("j"))


def point_grid(spark: SparkSession, box, side: float, unit: str = "kilometers") -> DataFrame:
    """(fid, geom): points from the south-west corner, up to and with the far edges."""
    x1, y1, x2, y2 = _box(box)
    s = _side(side, unit, y1, y2)
    cells = lattice(spark, _steps(x1, x2, s, True), _steps(y1, y2, s, True))
    return cells.select("fid", G.point(x1 + F.col("i") * s, y1 + F.col("j") * s).alias("geom"))


def square_grid(spark: SparkSession, box, side: float, unit: str = "kilometers") -> DataFrame:
    """(fid, geom): squares; the last ones may overhang the box."""
    x1, y1, x2, y2 = _box(box)
    s = _side(side, unit, y1, y2)
    x, y = x1 + F.col("i") * s, y1 + F.col("j") * s
    return lattice(spark, _steps(x1, x2, s, False), _steps(y1, y2, s, False)).select("fid", G.box_polygon(x, y, x + s, y + s).alias("geom"))


def rectangle_grid(spark: SparkSession, box, width: float, height: float, unit: str = "kilometers") -> DataFrame:
    """(fid, geom): rectangles cut at the box; only widths are stretched by the latitude."""
    x1, y1, x2, y2 = _box(box)
    if width <= 0 or height <= 0:
        raise ValueError("width and height must be positive")
    w, h = _side(width, unit, y1, y2), convert_length(height, unit, "degrees")
    x, y = x1 + F.col("i") * w, y1 + F.col("j") * h
    cells = lattice(spark, _steps(x1, x2, w, False), _steps(y1, y2, h, False))
    return cells.select("fid", G.box_polygon(x, y, F.least(x + w, F.lit(x2)), F.least(y + h, F.lit(y2))).alias("geom"))


def triangle_grid(spark: SparkSession, box, side: float, unit: str = "kilometers") -> DataFrame:
    """(fid, geom): two triangles for each square."""
    x1, y1, x2, y2 = _box(box)
    s = _side(side, unit, y1, y2)
    x, y = x1 + F.col("i") * s, y1 + F.col("j") * s
    a, b, c, d = G.position(x, y), G.position(x + s, y), G.position(x + s, y + s), G.position(x, y + s)
    both = F.array(G.polygon(F.array(F.array(a, c, d, a))), G.polygon(F.array(F.array(a, b, c, a))))
    cells = lattice(spark, _steps(x1, x2, s, False), _steps(y1, y2, s, False))
    return cells.select("fid", F.posexplode(both).alias("k", "geom")).select((F.col("fid") * 2 + F.col("k")).alias("fid"), "geom")


def hex_grid(spark: SparkSession, box, side: float) -> DataFrame:
    """(fid, geom): hexagons about points two sides apart, in rows three quarters of their
    height apart, every other row one side to the west; one hexagon at least. The side is
    in degrees."""
    x1, y1, x2, y2 = _box(box)
    s = _side(side, "degrees", y1, y2, max(x2 - x1, 0.001))
    dx, dy = s * 2, s * math.sqrt(3) * 3 / 4
    rows, even, odd = _steps(y1, y2, dy, False), _steps(x1, x2, dx, False), _steps(x1 - s, x2, dx, False)
    if not rows or not max(even, odd):
        rows, even, odd = 1, 1, 1
    wide = max(even, odd)
    shift = (F.col("i") % 2) == 1
    cells = lattice(spark, rows, wide).filter(F.col("j") < F.when(shift, F.lit(odd)).otherwise(F.lit(even)))
    cx = F.lit(x1) - F.when(shift, F.lit(s)).otherwise(F.lit(0.0)) + F.col("j") * dx
    cy = y1 + F.col("i") * dy
    h = s * math.sqrt(3) / 2
    corners = ((s / 2, h), (s, 0), (s / 2, -h), (-s / 2, -h), (-s, 0), (-s / 2, h), (s / 2, h))
    return cells.select("fid", G.polygon(F.array(F.array(*(G.position(cx + a, cy + b) for a, b in corners)))).alias("geom"))


def _uniform(lo: float, hi: float, seed: int) -> Column:
    return F.lit(lo) + F.rand(seed) * (hi - lo)


def random_points(spark: SparkSession, n: int, box=WORLD, seed: int = 0) -> DataFrame:
    x1, y1, x2, y2 = _box(box)
    return spark.range(n).select(F.col("id").alias("fid"), G.point(_uniform(x1, x2, seed), _uniform(y1, y2, seed + 1)).alias("geom"))


def _hash_unit(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone, so that it is the same on a retry."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def random_lines(spark: SparkSession, n: int, box=WORLD, vertices: int = 10, max_length: float = 1.0, max_turn: float = math.pi / 8, seed: int = 0) -> DataFrame:
    """Random walks: steps of up to ``max_length`` degrees that turn by up to ``max_turn`` radians."""
    x1, y1, x2, y2 = _box(box)
    fid = F.col("id")
    u = lambda k, i: _hash_unit(seed + k, fid, i)
    zero = F.lit(0)
    start = F.struct(F.array(G.position(x1 + u(0, zero) * (x2 - x1), y1 + u(1, zero) * (y2 - y1))).alias("path"), (u(2, zero) * 2 * math.pi).alias("turn"))

    def step(acc: Column, i: Column) -> Column:
        turn = acc["turn"] + (u(3, i) * 2 - 1) * max_turn
        size, last = u(4, i) * max_length, F.element_at(acc["path"], -1)
        return F.struct(F.concat(acc["path"], F.array(F.array(last[0] + size * F.cos(turn), last[1] + size * F.sin(turn)))).alias("path"), turn.alias("turn"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(max(2, vertices) - 1)), start, step, lambda acc: acc["path"])
    return spark.range(n).select(fid.alias("fid"), G.linestring(path).alias("geom"))


def random_polygons(spark: SparkSession, n: int, box=WORLD, vertices: int = 10, max_radius: float = 10.0, seed: int = 0) -> DataFrame:
    """Star-shaped polygons about random centres."""
    x1, y1, x2, y2 = _box(box)
    fid, zero = F.col("id"), F.lit(0)
    u = lambda k, i: _hash_unit(seed + k, fid, i)
    cx, cy = x1 + u(0, zero) * (x2 - x1), y1 + u(1, zero) * (y2 - y1)
    m = max(3, vertices)
    ring = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.array(cx + (0.1 + 0.9 * u(2, i)) * max_radius * F.cos(i * 2 * math.pi / m), cy + (0.1 + 0.9 * u(2, i)) * max_radius * F.sin(i * 2 * math.pi / m)))
    return spark.range(n).select(fid.alias("fid"), G.polygon(F.array(F.concat(ring, F.slice(ring, 1, 1)))).alias("geom"))


def sample(features: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n features without replacement, the same for a seed."""
    return features.orderBy(F.xxhash64("fid", F.lit(seed)), "fid").limit(n)


def flatten(features: DataFrame) -> DataFrame:
    """One row per single part, other columns kept; ``part`` numbers the parts. A
    collection's members are rows already (see the source)."""
    g = F.col("geom")
    point_parts = F.transform(G.positions("geom"), lambda p: G.geom("Point", F.array(F.array(F.array(p)))))
    line_parts = F.transform(G.rings("geom"), lambda r: G.geom("LineString", F.array(F.array(r))))
    area_parts = F.transform(g["coords"], lambda rs: G.geom("Polygon", F.array(rs)))
    parts = F.when(g["type"] == "MultiPoint", point_parts).when(g["type"] == "MultiLineString", line_parts).when(g["type"] == "MultiPolygon", area_parts).otherwise(F.array(g))
    rest = [c for c in features.columns if c != "geom"]
    return features.select(*rest, F.posexplode(parts).alias("part", "geom"))


explode = flatten


def explode_vertices(features: DataFrame) -> DataFrame:
    """One row per vertex: the other columns, pos, x, y, z (null if flat)."""
    rest = [c for c in features.columns if c != "geom"]
    rows = features.select(*rest, F.posexplode(G.positions("geom")).alias("pos", "_p"))
    return rows.select(*rest, "pos", F.get("_p", F.lit(0)).alias("x"), F.get("_p", F.lit(1)).alias("y"), F.get("_p", F.lit(2)).alias("z"))


def explode_segments(features: DataFrame) -> DataFrame:
    """One row per segment of lines and rings, as a LineString ``geom`` with its number ``seg``."""
    rest = [c for c in features.columns if c != "geom"]
    rows = features.select(*rest, F.posexplode(L.segments("geom")).alias("seg", "_s"))
    return rows.select(*rest, "seg", G.linestring(F.array("_s.a", "_s.b")).alias("geom"))


def explode_chunks(features: DataFrame, size: float, unit: str = "kilometers", mode: str = "reference") -> DataFrame:
    rest = [c for c in features.columns if c != "geom"]
    return features.select(*rest, F.posexplode(L.chunks("geom", size, unit, mode)).alias("chunk", "geom"))


def random_positions(spark: SparkSession, n: int, box=WORLD, seed: int = 0) -> DataFrame:
    """(fid, lng, lat): plain positions in a box."""
    x1, y1, x2, y2 = _box(box)
    return spark.range(n).select(F.col("id").alias("fid"), _uniform(x1, x2, seed).alias("lng"), _uniform(y1, y2, seed + 1).alias("lat"))
