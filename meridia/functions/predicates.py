"""Spatial predicates on geometry columns, as nested higher-order functions.

They answer as a widely used family of planar libraries does, also where that is not
textbook topology: containment looks at vertices only, and a line strictly inside a
polygon doesn't intersect it. ``mode="corrected"`` mends the latter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions import points as P
from meridia.schema import LINE, MULTILINE, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON


def on_ring(x: Column, y: Column, ring: Column) -> Column:
    return F.exists(G.edges(ring), lambda e: P.on_segment(x, y, e["a"][0], e["a"][1], e["b"][0], e["b"][1]))


def ray_cast(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over the ring's edges, and the one that closes it."""

    def crossed(e: Column) -> Column:
        ax, ay, bx, by = e["a"][0], e["a"][1], e["b"][0], e["b"][1]
        straddles = (ay > y) != (by > y)
        return F.when(straddles & (x < F.try_divide((bx - ax) * (y - ay), by - ay) + ax), 1).otherwise(0)

    loop = F.concat(ring, F.slice(ring, 1, 1))
    return F.aggregate(G.edges(loop), F.lit(0), lambda acc, e: acc + crossed(e)) % 2 == 1


def in_rings(x: Column, y: Column, rings: Column) -> Column:
    """On the exterior, or inside it and not strictly inside a hole."""
    outer = F.get(rings, F.lit(0))
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    hole = F.exists(holes, lambda h: ray_cast(x, y, h) & ~on_ring(x, y, h))
    edge = F.exists(holes, lambda h: on_ring(x, y, h))
    return on_ring(x, y, outer) | (ray_cast(x, y, outer) & (edge | ~hole))


def _side(x: Column, y: Column, ring: Column) -> Column:
    """Array of struct (on, left) for the edges of a closed ring: whether the point is on an
    edge, and whether a ray to the right meets it. An edge is seen from its lower end, so
    polygons that share it agree."""

    def one(e: Column) -> Column:
        up = (e["a"][1] < e["b"][1]) | ((e["a"][1] == e["b"][1]) & (e["a"][0] <= e["b"][0]))
        ends = F.when(up, F.struct(e["a"].alias("p"), e["b"].alias("q"))).otherwise(F.struct(e["b"].alias("p"), e["a"].alias("q")))

        def seen(s: Column) -> Column:
            px, py, qx, qy = s["p"][0], s["p"][1], s["q"][0], s["q"][1]
            run, rise = (qx - px) * (y - py), (qy - py) * (x - px)
            within = (y >= py) & (y <= qy) & (x >= F.least(px, qx)) & (x <= F.greatest(px, qx))
            return F.struct((within & (run == rise)).alias("on"), ((y >= py) & (y < qy) & (run > rise)).alias("left"))

        return G.let(ends, seen)

    loop = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    return F.transform(G.edges(loop), one)


def xy_in_polygon_exact(x, y, g) -> Column:
    """As ``xy_in_polygon`` without a tolerance: coordinates are taken as they stand, and a
    point a rounding beside an edge is not on it."""
    x, y = P._c(x), P._c(y)
    on = lambda sides: F.exists(sides, lambda s: s["on"])
    odd = lambda sides: F.size(F.filter(sides, lambda s: s["left"])) % 2 == 1

    def inside(rings: Column) -> Column:
        sides = F.transform(rings, lambda r: _side(x, y, r))
        return G.let(sides, lambda v: F.exists(v, on) | (odd(v[0]) & ~F.exists(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), odd)))

    return F.exists(G._c(g)["coords"], inside)


def xy_in_polygon(x, y, g) -> Column:
    """Whether plain coordinates are in a Polygon or MultiPolygon; their box is tested first."""
    x, y = P._c(x), P._c(y)
    return F.exists(G._c(g)["coords"], lambda rings: in_rings(x, y, rings))


def point_in_polygon(p, g) -> Column:
    """Whether a Point, or all of a MultiPoint, is in an areal geometry, boundary included."""
    return F.when(G.get_type(p).isin(POINT, MULTIPOINT) & G.is_areal(g), F.forall(G.positions(p), lambda q: xy_in_polygon(q[0], q[1], g)))


def on_path(x: Column, y: Column, path: Column, ignore_ends: bool = False) -> Column:
    def hit(e: Column) -> Column:
        on = P.on_segment(x, y, e["a"][0], e["a"][1], e["b"][0], e["b"][1])
        if not ignore_ends:
            return on
        end = ((x == e["a"][0]) & (y == e["a"][1])) | ((x == e["b"][0]) & (y == e["b"][1]))
        return on & ~end

    return F.exists(G.edges(path), hit)


def point_on_line(p, g, ignore_ends: bool = False) -> Column:
    """Whether a point is on a line or a polygon's rings; ends of segments can be left out."""
    linear = G.get_type(g).isin(LINE, MULTILINE, POLYGON, MULTIPOLYGON)
    return linear & F.exists(F.flatten(G._c(g)["coords"]), lambda r: on_path(G.x_of(p), G.y_of(p), r, ignore_ends))


def _paths(g) -> Column:
    return F.flatten(G._c(g)["coords"])


def _paths_meet(a: Column, b: Column) -> Column:
    meet = lambda e, f: P.segments_meet(e["a"][0], e["a"][1], e["b"][0], e["b"][1], f["a"][0], f["a"][1], f["b"][0], f["b"][1])
    return F.exists(a, lambda r: F.exists(b, lambda s: F.exists(G.edges(r), lambda e: F.exists(G.edges(s), lambda f: meet(e, f)))))


def _puntal(g) -> Column:
    return G.get_type(g).isin(POINT, MULTIPOINT)


def _linear(g) -> Column:
    return G.get_type(g).isin(LINE, MULTILINE)


def _same(p: Column, q: Column) -> Column:
    return (p[0] == q[0]) & (p[1] == q[1])


def _path_in_rings(path: Column, rings: Column) -> Column:
    """All vertices of the path on some ring or in the polygon."""
    return F.forall(path, lambda p: F.exists(rings, lambda r: on_ring(p[0], p[1], r)) | in_rings(p[0], p[1], rings))


def _polygon_in_rings(inner: Column, rings: Column) -> Column:
    outer = F.get(inner, F.lit(0))
    holes = F.slice(inner, 2, F.greatest(F.size(inner) - 1, F.lit(0)))
    vertices = F.forall(F.slice(outer, 1, F.greatest(F.size(outer) - 1, F.lit(0))), lambda p: in_rings(p[0], p[1], rings))
    clear = lambda p: F.exists(rings, lambda r: on_ring(p[0], p[1], r)) | ~in_rings(p[0], p[1], rings)
    return vertices & F.forall(holes, lambda h: F.forall(h, clear))


def contains(a, b) -> Column:
    """Whether a contains b, judged by b's vertices. Every part of a multi-point or
    multi-line must contain b; one polygon of a multi-polygon is enough."""
    ta, tb = G.get_type(a), G.get_type(b)
    pb, polys_a, polys_b = G.positions(b), G._c(a)["coords"], G._c(b)["coords"]
    point_has = F.when(_puntal(b), F.forall(G.positions(a), lambda p: F.exists(pb, lambda q: _same(p, q)))).otherwise(False)
    line_has = F.when(tb.isin(POINT, MULTIPOINT, LINE), F.forall(G.rings(a), lambda r: F.forall(pb, lambda q: on_path(q[0], q[1], r)))).otherwise(False)
    lines_in = lambda rings: F.forall(_paths(b), lambda r: _path_in_rings(r, rings))
    polygon_has = (
        F.when(_puntal(b), F.forall(pb, lambda q: F.exists(polys_a, lambda rings: in_rings(q[0], q[1], rings))))
        .when(_linear(b), F.exists(polys_a, lines_in))
        .otherwise(F.forall(polys_b, lambda inner: F.exists(polys_a, lambda rings: _polygon_in_rings(inner, rings))))
    )
    return F.when(ta.isin(POINT, MULTIPOINT), point_has).when(ta.isin(LINE, MULTILINE), line_has).when(ta.isin(POLYGON, MULTIPOLYGON), polygon_has).otherwise(False)


def within(a, b) -> Column:
    return contains(b, a)


def _points_meet(p, g) -> Column:
    ps = G.positions(p)
    return (
        F.when(_puntal(g), F.exists(ps, lambda q: F.exists(G.positions(g), lambda r: _same(q, r))))
        .when(_linear(g), F.exists(ps, lambda q: F.exists(_paths(g), lambda r: on_path(q[0], q[1], r))))
        .otherwise(F.exists(ps, lambda q: xy_in_polygon(q[0], q[1], g)))
    )


def intersects(a, b, mode: str = "reference") -> Column:
    """Whether the geometries share a point: vertices for points, crossing segments for
    lines; for two polygons also if a contains b (mode="corrected": or b contains a, and
    a line may lie inside a polygon)."""
    meet = _paths_meet(_paths(a), _paths(b))
    # Boxes that are apart settle most pairs before any segment is looked at.
    p, q = G.bbox(a), G.bbox(b)
    slack = 1e-9
    near = (p["minx"] <= q["maxx"] + slack) & (q["minx"] <= p["maxx"] + slack) & (p["miny"] <= q["maxy"] + slack) & (q["miny"] <= p["maxy"] + slack)
    nested = F.when(G.is_areal(a) & G.is_areal(b), contains(a, b)).otherwise(False)
    if mode == "corrected":
        nested = nested | F.when(G.is_areal(b), contains(b, a)).otherwise(False) | F.when(G.is_areal(a), contains(a, b)).otherwise(False)
    answer = F.when(_puntal(a), _points_meet(a, b)).when(_puntal(b), _points_meet(b, a)).otherwise(meet | nested)
    return F.when(near, answer).otherwise(False)


def disjoint(a, b, mode: str = "reference") -> Column:
    return ~intersects(a, b, mode)


def touches(a, b) -> Column:
    """Never for a Point; otherwise intersecting and, where an area is involved, neither within the other."""
    inside = F.when(G.is_areal(a) | G.is_areal(b), contains(a, b) | contains(b, a)).otherwise(False)
    return (G.get_type(a) != POINT) & (G.get_type(b) != POINT) & intersects(a, b) & ~inside


def crosses(a, b) -> Column:
    both = (G.get_type(a) == POINT) & (G.get_type(b) == POINT)
    return ~both & intersects(a, b) & ~contains(a, b) & ~contains(b, a)


def overlap(a, b) -> Column:
    same = (G.get_type(a) == G.get_type(b)) & G.get_type(a).isin(LINE, MULTILINE, POLYGON, MULTIPOLYGON)
    return same & intersects(a, b) & ~contains(a, b) & ~contains(b, a)


def valid(g) -> Column:
    """Enough positions, and closed rings of four or more."""
    t, coords = G.get_type(g), G._c(g)["coords"]
    ring_ok = lambda r: (F.size(r) >= 4) & _same(F.element_at(r, 1), F.element_at(r, -1))
    rings_ok = lambda poly: (F.size(poly) > 0) & F.forall(poly, lambda r: F.coalesce(ring_ok(r), F.lit(False)))
    wide = lambda p: F.size(p) >= 2
    answer = (
        F.when(t == POINT, (F.size(G.positions(g)) == 1) & F.forall(G.positions(g), wide))
        .when(t == MULTIPOINT, (F.size(G.positions(g)) > 0) & F.forall(G.positions(g), wide))
        .when(t == LINE, F.size(G.path(g)) >= 2)
        .when(t == MULTILINE, (F.size(G.rings(g)) > 0) & F.forall(G.rings(g), lambda r: F.size(r) >= 2))
        .when(t.isin(POLYGON, MULTIPOLYGON), (F.size(coords) > 0) & F.forall(coords, rings_ok))
    )
    return F.coalesce(answer, F.lit(False))


def concave(g) -> Column:
    """Whether a Polygon's exterior has a reflex corner."""
    ring = G.path(g)
    n = F.size(ring) - 1

    def reflex(i: Column) -> Column:
        a, b, c = (F.get(ring, (i + k) % n) for k in range(3))
        cross = (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])
        return F.when(G.clockwise(ring), cross > 1e-10).otherwise(cross < -1e-10)

    return F.when((G.get_type(g) == POLYGON) & (F.size(ring) >= 4), F.exists(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), reflex)).otherwise(False)


def equal(a, b) -> Column:
    """The same coordinates in the same order, nested alike (a MultiPoint equals a LineString)."""
    depth = lambda g: F.when(G.get_type(g) == POINT, 0).when(G.get_type(g).isin(MULTIPOINT, LINE), 1).when(G.get_type(g).isin(MULTILINE, POLYGON), 2).otherwise(3)
    return (depth(a) == depth(b)) & (G._c(a)["coords"] == G._c(b)["coords"])


def parallel(a, b) -> Column:
    """Whether each segment of a is parallel to b's of the same number; null unless both
    are lines and b has as many segments."""
    ea, eb = G.edges(G.path(a)), G.edges(G.path(b))
    fits = (G.get_type(a).isin(LINE, MULTIPOINT)) & (G.get_type(b).isin(LINE, MULTIPOINT)) & (F.size(ea) >= 1) & (F.size(eb) >= F.size(ea))
    cross = lambda e, f: (e["b"][0] - e["a"][0]) * (f["b"][1] - f["a"][1]) - (e["b"][1] - e["a"][1]) * (f["b"][0] - f["a"][0])
    flat = F.zip_with(ea, F.slice(eb, 1, F.greatest(F.size(ea), F.lit(0))), lambda e, f: F.abs(cross(e, f)) <= 1e-10)
    return F.when(fits, F.forall(flat, lambda x: x))
