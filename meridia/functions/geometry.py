"""Geometry columns: constructors, accessors, measures and per-row transforms.

A geometry is a struct of its type and coordinates nested like a MultiPolygon's, so a
transform is one nested higher-order function whatever the type is.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridia.functions import points as P
from meridia.schema import EARTH_RADIUS, GEOM_DDL, LINE, METRES_PER_DEGREE, MULTILINE, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON, metres

PI = math.pi


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# constructors


def geom(kind: str | Column, coords: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), coords.alias("coords")).cast(GEOM_DDL)


def position(x, y, z=None) -> Column:
    parts = [P._c(x).cast("double"), P._c(y).cast("double")] + ([] if z is None else [P._c(z).cast("double")])
    return F.array(*parts)


def point(x, y, z=None) -> Column:
    return geom(POINT, F.array(F.array(F.array(position(x, y, z)))))


def multipoint(positions) -> Column:
    return geom(MULTIPOINT, F.array(F.array(_c(positions))))


def linestring(positions) -> Column:
    return geom(LINE, F.array(F.array(_c(positions))))


def multilinestring(paths) -> Column:
    return geom(MULTILINE, F.array(_c(paths)))


def polygon(rings) -> Column:
    return geom(POLYGON, F.array(_c(rings)))


def multipolygon(polygons) -> Column:
    return geom(MULTIPOLYGON, _c(polygons))


def box_polygon(minx, miny, maxx, maxy) -> Column:
    """The box's rectangle, counter-clockwise from its south-west corner."""
    a, b, c, d = (P._c(v) for v in (minx, miny, maxx, maxy))
    return polygon(F.array(F.array(position(a, b), position(c, b), position(c, d), position(a, d), position(a, b))))


# accessors


def get_type(g) -> Column:
    return _c(g)["type"]


def get_coord(g) -> Column:
    """A Point's position, null for other types."""
    return F.when(get_type(g) == POINT, F.get(path(g), F.lit(0)))


def path(g) -> Column:
    """The first list of positions: a line's path or a polygon's exterior."""
    return F.get(F.get(_c(g)["coords"], F.lit(0)), F.lit(0))


def rings(g) -> Column:
    return F.get(_c(g)["coords"], F.lit(0))


def positions(g) -> Column:
    """All positions in order."""
    return F.flatten(F.flatten(_c(g)["coords"]))


def lng(p: Column) -> Column:
    return F.coalesce(F.get(p, F.lit(0)), F.lit(0.0))


def lat(p: Column) -> Column:
    return F.coalesce(F.get(p, F.lit(1)), F.lit(0.0))


def elevation(p: Column) -> Column:
    return F.coalesce(F.get(p, F.lit(2)), F.lit(0.0))


def x_of(g) -> Column:
    return F.get(get_coord(g), F.lit(0))


def y_of(g) -> Column:
    return F.get(get_coord(g), F.lit(1))


def coord_count(g) -> Column:
    return F.size(positions(g))


def dimensions(g) -> Column:
    return F.when(get_type(g).isin(LINE, MULTILINE), 1).when(get_type(g).isin(POLYGON, MULTIPOLYGON), 2).otherwise(0)


def is_areal(g) -> Column:
    return get_type(g).isin(POLYGON, MULTIPOLYGON)


def edges(ring: Column) -> Column:
    """The path's segments as structs of (a, b)."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def total(items: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + value(x))


# measures


def length(g, unit: str = "kilometers", mode: str = "reference") -> Column:
    """Length of a LineString (a MultiPoint's path too, 0 for a Point). Other types are
    null, or with mode="corrected" the sum over all paths."""
    step = lambda e: P.haversine(e["a"][0], e["a"][1], e["b"][0], e["b"][1])
    one = lambda r: total(edges(r), step)
    line = F.when(get_type(g) == POINT, F.lit(0.0)).when(get_type(g).isin(LINE, MULTIPOINT), one(path(g)))
    if mode == "corrected":
        line = line.otherwise(total(F.flatten(_c(g)["coords"]), one))
    return line / F.lit(metres(unit))


def ring_area(ring: Column) -> Column:
    """Signed spherical area of a ring in square metres."""
    term = lambda e: F.radians(e["b"][0] - e["a"][0]) * (2 + F.sin(F.radians(e["a"][1])) + F.sin(F.radians(e["b"][1])))
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(total(edges(ring), term) * F.lit(EARTH_RADIUS * EARTH_RADIUS / 2))


def area(g, mode: str = "reference") -> Column:
    """Area in square metres, 0 for points and lines. Holes count by their winding, so
    that one wound like the exterior is taken off and one wound against it added;
    mode="corrected" takes every hole off."""

    def one(poly: Column) -> Column:
        areas = F.transform(poly, ring_area)
        outer = F.get(areas, F.lit(0))
        holes = F.slice(areas, 2, F.greatest(F.size(areas) - 1, F.lit(0)))
        if mode == "corrected":
            return F.abs(outer) - total(holes, F.abs)
        return F.abs(outer - total(holes, lambda a: a))

    return F.when(is_areal(g), total(_c(g)["coords"], one)).otherwise(F.lit(0.0))


def bbox(g) -> Column:
    xs, ys = F.transform(positions(g), lambda p: p[0]), F.transform(positions(g), lambda p: p[1])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def envelope(g) -> Column:
    b = bbox(g)
    return box_polygon(b["minx"], b["miny"], b["maxx"], b["maxy"])


def square(minx, miny, maxx, maxy) -> Column:
    """The box with its shorter side widened about the centre."""
    a, b, c, d = (P._c(v) for v in (minx, miny, maxx, maxy))
    half = F.greatest(c - a, d - b) / 2
    cx, cy = (a + c) / 2, (b + d) / 2
    return F.struct((cx - half).alias("minx"), (cy - half).alias("miny"), (cx + half).alias("maxx"), (cy + half).alias("maxy"))


def center(g) -> Column:
    b = bbox(g)
    return point((b["minx"] + b["maxx"]) / 2, (b["miny"] + b["maxy"]) / 2)


def vertex_mean(ps: Column) -> tuple[Column, Column]:
    n = F.nullif(F.size(ps), F.lit(0))
    return total(ps, lambda p: p[0]) / n, total(ps, lambda p: p[1]) / n


def centroid(g) -> Column:
    """Mean of all vertices, a ring's closing one included; null without any."""
    x, y = vertex_mean(positions(g))
    return F.when(F.size(positions(g)) > 0, point(x, y))


def center_of_mass(g, mode: str = "reference") -> Column:
    """The vertex mean, or with mode="corrected" the area-weighted planar centre of polygons."""
    if mode != "corrected":
        return centroid(g)
    rs = F.flatten(_c(g)["coords"])
    cross = lambda e: e["a"][0] * e["b"][1] - e["b"][0] * e["a"][1]
    twice = total(rs, lambda r: total(edges(r), cross))
    moment = lambda k: total(rs, lambda r: total(edges(r), lambda e: (e["a"][k] + e["b"][k]) * cross(e)))
    return F.when(is_areal(g) & (twice != 0), point(F.try_divide(moment(0), 3 * twice), F.try_divide(moment(1), 3 * twice))).otherwise(centroid(g))


def point_on_feature(g) -> Column:
    """A vertex of points (the first) and lines (the middle one); the vertex mean of the
    first polygon, which need not lie inside."""
    p = path(g)
    x, y = vertex_mean(F.flatten(rings(g)))
    at = lambda q: point(q[0], q[1])
    middle = F.get(p, F.floor(F.size(p) / 2).cast("int"))
    return F.when(get_type(g).isin(POINT, MULTIPOINT), at(F.get(p, F.lit(0)))).when(get_type(g).isin(LINE, MULTILINE), at(middle)).otherwise(point(x, y))


# transforms


def map_positions(g, f: Callable[[Column], Column]) -> Column:
    nested = F.transform(_c(g)["coords"], lambda poly: F.transform(poly, lambda ring: F.transform(ring, f)))
    return geom(get_type(g), nested)


def map_rings(g, f: Callable[[Column], Column]) -> Column:
    return geom(get_type(g), F.transform(_c(g)["coords"], lambda poly: F.transform(poly, f)))


def _pivot(g, pivot) -> tuple[Column, Column]:
    if pivot is None:
        return vertex_mean(positions(g))
    return (P._c(pivot[0]), P._c(pivot[1])) if isinstance(pivot, (tuple, list)) else (x_of(pivot), y_of(pivot))


def rotate(g, degrees, pivot=None) -> Column:
    """Planar rotation, counter-clockwise, about a point or the vertex mean; drops heights."""
    px, py = _pivot(g, pivot)
    cos, sin = F.cos(F.radians(P._c(degrees))), F.sin(F.radians(P._c(degrees)))
    return map_positions(g, lambda p: F.array(px + (p[0] - px) * cos - (p[1] - py) * sin, py + (p[0] - px) * sin + (p[1] - py) * cos))


def scale(g, fx, fy=None, pivot=None) -> Column:
    px, py = _pivot(g, pivot)
    fx, fy = P._c(fx), P._c(fx if fy is None else fy)
    return map_positions(g, lambda p: F.array(px + (p[0] - px) * fx, py + (p[1] - py) * fy))


def translate(g, dx, dy, unit: str = "degrees") -> Column:
    """A shift in degrees, or in a length turned into degrees at the vertices' mean latitude."""
    dx, dy = P._c(dx), P._c(dy)
    if unit != "degrees":
        _, mean = vertex_mean(positions(g))
        dx = F.try_divide(dx * metres(unit), METRES_PER_DEGREE * F.cos(F.radians(mean)))
        dy = dy * (metres(unit) / METRES_PER_DEGREE)
    return map_positions(g, lambda p: F.array(p[0] + dx, p[1] + dy))


def flip(g) -> Column:
    return map_positions(g, lambda p: F.concat(F.array(p[1], p[0]), F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(0)))))


def truncate(g, precision: int = 6, dims: int = 3) -> Column:
    """Rounds (half away from zero) to a number of decimals and keeps the first ``dims`` values."""
    unit = float(10**precision)
    return map_positions(g, lambda p: F.transform(F.slice(p, 1, dims), lambda v: F.signum(v) * F.floor(F.abs(v) * unit + 0.5) / unit))


def clean_coords(g) -> Column:
    """Without vertices that equal the one before."""
    return map_rings(g, lambda r: F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1))))


def signed_turn(ring: Column) -> Column:
    return total(edges(ring), lambda e: (e["b"][0] - e["a"][0]) * (e["b"][1] + e["a"][1]))


def clockwise(ring: Column) -> Column:
    return signed_turn(ring) > 0


def rewind(g, reverse: bool = False) -> Column:
    """Exteriors clockwise and holes counter-clockwise, or the other way round."""

    def one(ring: Column, i: Column) -> Column:
        wanted = (i == 0) if not reverse else (i != 0)
        return F.when(clockwise(ring) == wanted, ring).otherwise(F.reverse(ring))

    return F.when(is_areal(g), geom(get_type(g), F.transform(_c(g)["coords"], lambda poly: F.transform(poly, one)))).otherwise(_c(g))


def to_mercator(g) -> Column:
    return map_positions(g, lambda p: F.concat(F.array(*P.mercator(p[0], p[1])), F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(0)))))


def to_wgs84(g) -> Column:
    return map_positions(g, lambda p: F.concat(F.array(*P.wgs84(p[0], p[1])), F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(0)))))


def smooth(g, iterations: int = 1) -> Column:
    """Corner cutting of polygon rings at a quarter of each edge, 1 to 5 times."""

    def once(ring: Column) -> Column:
        mix = lambda e, t: F.array(e["a"][0] * (1 - t) + e["b"][0] * t, e["a"][1] * (1 - t) + e["b"][1] * t)
        cut = F.flatten(F.transform(edges(ring), lambda e: F.array(mix(e, 0.25), mix(e, 0.75))))
        return F.concat(cut, F.slice(cut, 1, 1))

    for _ in range(max(1, min(5, iterations))):
        g = map_rings(g, once)
    return F.when(is_areal(g), g)


def polygon_to_line(g) -> Column:
    """The exterior as a LineString, a MultiPolygon's exteriors as a MultiLineString."""
    many = multilinestring(F.transform(_c(g)["coords"], lambda poly: poly[0]))
    return F.when(get_type(g) == POLYGON, linestring(path(g))).when(get_type(g) == MULTIPOLYGON, many)


def line_to_polygon(g) -> Column:
    """Closes the line (each line of a MultiLineString) into a ring of one polygon; null
    for under three positions."""
    closed = lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    rs = rings(g)
    return F.when(get_type(g).isin(LINE, MULTILINE) & F.forall(rs, lambda r: F.size(r) >= 3), polygon(F.transform(rs, closed)))


# shapes


def _vertex(x, y, r, brg: Column, unit: str) -> Column:
    return F.array(*P.destination(x, y, r, brg, unit))


def ellipse(x, y, rx, ry, steps: int = 64, unit: str = "kilometers", angle=0.0, mode: str = "reference") -> Column:
    """A polygon about a centre. By default a vertex is the sum of two destinations, at
    the step's angle and square to it, which makes a circle of radius sqrt(rx² + ry²);
    mode="corrected" has the half axes rx (east) and ry (north)."""
    x, y, rx, ry = (P._c(v) for v in (x, y, rx, ry))
    turn = F.radians(P._c(angle))

    def vertex(i: Column) -> Column:
        theta = F.lit(360.0) * i / steps
        if mode == "corrected":
            t = F.radians(theta)
            ex, ny = rx * F.cos(t), ry * F.sin(t)
            brg = F.degrees(F.atan2(ex, ny)) - P._c(angle)
            return _vertex(x, y, F.hypot(ex, ny), brg, unit)
        a, b = P.destination(x, y, rx, theta, unit), P.destination(x, y, ry, theta + 90, unit)
        dx, dy = a[0] - x + b[0] - x, a[1] - y + b[1] - y
        return F.array(x + dx * F.cos(turn) - dy * F.sin(turn), y + dx * F.sin(turn) + dy * F.cos(turn))

    ring = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), vertex)
    return polygon(F.array(F.concat(ring, F.slice(ring, 1, 1))))


def circle(x, y, radius, steps: int = 64, unit: str = "kilometers", mode: str = "reference") -> Column:
    if mode == "corrected":
        ring = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: _vertex(P._c(x), P._c(y), P._c(radius), F.lit(-360.0) * i / steps, unit))
        return polygon(F.array(F.concat(ring, F.slice(ring, 1, 1))))
    return ellipse(x, y, radius, radius, steps, unit)


def _arc(x, y, radius, b1, b2, steps: int, unit: str) -> Column:
    steps = steps if steps >= 1 else 64
    b1, b2 = P._c(b1), P._c(b2)
    span = F.when(b1 <= b2, b2 - b1).otherwise(360 + b2 - b1)
    turn = lambda i: b1 + span * i / steps
    folded = lambda i: F.when((b1 > b2) & (turn(i) >= 360), turn(i) - 360).otherwise(turn(i))
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: _vertex(P._c(x), P._c(y), P._c(radius), folded(i), unit))


def line_arc(x, y, radius, b1, b2, steps: int = 64, unit: str = "kilometers") -> Column:
    """The arc from one bearing to the other, through north when the first is greater."""
    return linestring(_arc(x, y, radius, b1, b2, steps, unit))


def sector(x, y, radius, b1, b2, steps: int = 64, unit: str = "kilometers") -> Column:
    mid = F.array(position(x, y))
    return polygon(F.array(F.concat(mid, _arc(x, y, radius, b1, b2, steps, unit), mid)))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def bezier_spline(g, sharpness: float = 0.85, resolution: int = 10000) -> Column:
    """A spline through the line's vertices, of ``resolution`` + 1 positions."""
    resolution = max(2, resolution)

    def axis(s: Column, d: int) -> Column:
        a, b, u, v = s["a"][d], s["b"][d], s["u"], 1 - s["u"]
        c1, c2 = a + (b - s["p"][d]) * sharpness, b - (s["q"][d] - a) * sharpness
        return F.when(s["n"] == 2, a + (b - a) * u).otherwise(v * v * v * a + 3 * v * v * u * c1 + 3 * v * u * u * c2 + u * u * u * b)

    def spot(r: Column, k: Column) -> Column:
        n = F.size(r)
        t = k * (n - 1) / resolution
        step = F.struct(F.least(F.floor(t).cast("int"), n - 2).alias("i"), t.alias("t"), n.alias("n"))
        at = lambda s: F.struct(F.get(r, F.greatest(F.lit(0), s["i"] - 1)).alias("p"), F.get(r, s["i"]).alias("a"), F.get(r, s["i"] + 1).alias("b"), F.get(r, F.least(s["n"] - 1, s["i"] + 2)).alias("q"), (s["t"] - s["i"]).alias("u"), s["n"].alias("n"))
        return let(let(step, at), lambda s: F.array(axis(s, 0), axis(s, 1)))

    curve = let(path(g), lambda r: F.transform(F.sequence(F.lit(0), F.lit(resolution)), lambda k: spot(r, k)))
    return F.when(F.size(path(g)) >= 2, linestring(curve))
