"""Operators on LineStrings, as expressions; those that give many lines give an array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions import points as P
from meridia.functions import predicates as Q
from meridia.schema import LINE, metres


def _metres(e: Column) -> Column:
    return P.haversine(e["a"][0], e["a"][1], e["b"][0], e["b"][1])


def _foot(x: Column, y: Column, e: Column) -> tuple[Column, Column]:
    """The point of a segment nearest to (x, y) in the plane of degrees."""
    dx, dy = e["b"][0] - e["a"][0], e["b"][1] - e["a"][1]
    t = F.coalesce(F.try_divide((x - e["a"][0]) * dx + (y - e["a"][1]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return e["a"][0] + t * dx, e["a"][1] + t * dy


def segment_distance(x: Column, y: Column, e: Column) -> Column:
    return P.haversine(x, y, *_foot(x, y, e))


def point_to_line(p, g, unit: str = "kilometers") -> Column:
    """Distance to the nearest segment; null for lines of under two positions."""
    x, y = G.x_of(p), G.y_of(p)
    return F.array_min(F.transform(G.edges(G.path(g)), lambda e: segment_distance(x, y, e))) / F.lit(metres(unit))


def nearest_point_on_line(g, p) -> Column:
    """Struct (dist in metres, index of the segment, x, y); the first of equally near ones."""
    from meridia.functions import kernels

    return kernels.nearest_on_path(F.array(G.x_of(p), G.y_of(p)), G.path(g))


def point_to_polygon(p, g, unit: str = "kilometers", mode: str = "reference") -> Column:
    """0 inside, else the distance to the nearest edge. Outside a MultiPolygon it is null,
    or with mode="corrected" the distance to the nearest part."""
    x, y = G.x_of(p), G.y_of(p)
    outside = F.array_min(F.transform(F.flatten(F.transform(F.flatten(G._c(g)["coords"]), G.edges)), lambda e: segment_distance(x, y, e)))
    if mode != "corrected":
        outside = F.when(G.get_type(g) == "Polygon", outside)
    return F.when(Q.xy_in_polygon(x, y, g), F.lit(0.0)).otherwise(outside / F.lit(metres(unit)))


def along_path(path: Column, target: Column) -> Column:
    """Position at a distance in metres; the last vertex beyond the end."""

    def step(acc: Column, e: Column) -> Column:
        size = _metres(e)
        here = acc["found"].isNull() & (acc["gone"] + size >= target)
        t = F.coalesce(F.try_divide(target - acc["gone"], size), F.lit(0.0))
        spot = F.array(e["a"][0] + (e["b"][0] - e["a"][0]) * t, e["a"][1] + (e["b"][1] - e["a"][1]) * t)
        return F.struct((acc["gone"] + size).alias("gone"), F.when(here, spot).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.lit(0.0).alias("gone"), F.lit(None).cast("array<double>").alias("found"))
    return F.aggregate(G.edges(path), start, step, lambda acc: F.coalesce(acc["found"], F.slice(F.element_at(path, -1), 1, 2)))


def along(g, dist, unit: str = "kilometers") -> Column:
    at = along_path(G.path(g), P._c(dist) * metres(unit))
    return G.point(at[0], at[1])


def great_circle(x1, y1, x2, y2, n: int = 100) -> Column:
    """The arc between two points as a LineString of n positions; null if they coincide.
    What all positions share is bound first: an expression used twice is evaluated twice."""
    lo1, la1, lo2, la2 = (F.radians(P._c(v)) for v in (x1, y1, x2, y2))
    half = F.sin((la2 - la1) / 2), F.sin((lo2 - lo1) / 2)
    d = 2 * F.asin(F.sqrt(half[0] * half[0] + F.cos(la1) * F.cos(la2) * half[1] * half[1]))
    names = ("x1", "y1", "x2", "y2", "z1", "z2")
    ends = F.cos(la1) * F.cos(lo1), F.cos(la1) * F.sin(lo1), F.cos(la2) * F.cos(lo2), F.cos(la2) * F.sin(lo2), F.sin(la1), F.sin(la2)

    def arc(c: Column) -> Column:
        def spot(i: Column) -> Column:
            f = i / (n - 1)
            w = F.struct(F.try_divide(F.sin((1 - f) * c["d"]), c["s"]).alias("a"), F.try_divide(F.sin(f * c["d"]), c["s"]).alias("b"))
            flat = lambda w: F.struct(*((w["a"] * c[f"{k}1"] + w["b"] * c[f"{k}2"]).alias(k) for k in "xyz"))
            return G.let(G.let(w, flat), lambda p: F.array(F.degrees(F.atan2(p["y"], p["x"])), F.degrees(F.atan2(p["z"], F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])))))

        return F.when(c["d"] > 0, G.linestring(F.transform(F.sequence(F.lit(0), F.lit(max(n, 2) - 1)), spot)))

    given = F.struct(d.alias("d"), *(e.alias(k) for k, e in zip(names, ends, strict=True)))
    return G.let(G.let(given, lambda c: F.struct(c["d"].alias("d"), F.sin(c["d"]).alias("s"), *(c[k].alias(k) for k in names))), arc)


def segments(g) -> Column:
    """All two-position segments of lines and rings, as an array of (a, b)."""
    return F.when(~G.get_type(g).isin("Point", "MultiPoint"), F.flatten(F.transform(F.flatten(G._c(g)["coords"]), G.edges)))


def slice_between(p1, p2, g) -> Column:
    """The line between the points of it nearest to two points; past the end it goes on
    from the beginning."""
    path = G.path(g)
    a, b = nearest_point_on_line(g, p1), nearest_point_on_line(g, p2)
    pa, pb = F.array(a["x"], a["y"]), F.array(b["x"], b["y"])
    n = F.size(path)
    ahead = F.slice(path, a["index"] + 2, F.greatest(b["index"] - a["index"], F.lit(0)))
    around = F.concat(F.slice(path, a["index"] + 2, F.greatest(n - a["index"] - 1, F.lit(0))), F.slice(path, 1, b["index"] + 1))
    from_start = lambda q: P.haversine(F.get(path, a["index"])[0], F.get(path, a["index"])[1], q["x"], q["y"])
    same = F.when(from_start(a) < from_start(b), F.array(pa, pb)).otherwise(F.array(pb, pa))
    return G.linestring(F.when(a["index"] < b["index"], F.concat(F.array(pa), ahead, F.array(pb))).when(a["index"] > b["index"], F.concat(F.array(pa), around, F.array(pb))).otherwise(same))


def _cut(path: Column, start: Column, stop: Column) -> Column:
    """Positions from one distance (metres) to another, with the ends of the segments
    that lie wholly between the two."""
    first, last = along_path(path, start), along_path(path, stop)
    lo, hi = F.least(start, stop), F.greatest(start, stop)

    def step(acc: Column, e: Column) -> Column:
        end = acc["gone"] + _metres(e)
        inner = (acc["gone"] >= lo) & (end <= hi) & (end > lo) & (acc["gone"] < hi)
        fresh = (F.slice(e["b"], 1, 2) != first) & (F.slice(e["b"], 1, 2) != last)
        kept = F.when(inner & fresh, F.concat(acc["kept"], F.array(F.slice(e["b"], 1, 2)))).otherwise(acc["kept"])
        return F.struct(end.alias("gone"), kept.alias("kept"))

    begin = F.struct(F.lit(0.0).alias("gone"), F.array(first).alias("kept"))
    found = F.aggregate(G.edges(path), begin, step, lambda acc: acc["kept"])
    return F.when(F.element_at(found, -1) == last, found).otherwise(F.concat(found, F.array(last)))


def _cut_corrected(path: Column, start: Column, stop: Column) -> Column:
    """As ``_cut``, with every vertex strictly between the two distances."""
    first, last = along_path(path, F.least(start, stop)), along_path(path, F.greatest(start, stop))
    lo, hi = F.least(start, stop), F.greatest(start, stop)

    def step(acc: Column, e: Column) -> Column:
        end = acc["gone"] + _metres(e)
        kept = F.when((end > lo) & (end < hi), F.concat(acc["kept"], F.array(F.slice(e["b"], 1, 2)))).otherwise(acc["kept"])
        return F.struct(end.alias("gone"), kept.alias("kept"))

    inner = F.aggregate(G.edges(path), F.struct(F.lit(0.0).alias("gone"), F.array().cast("array<array<double>>").alias("kept")), step, lambda acc: acc["kept"])
    return F.concat(F.array(first), inner, F.array(last))


def slice_along(g, start, stop, unit: str = "kilometers", mode: str = "reference") -> Column:
    """The line from one distance along it to another. By default the vertex that ends the
    first, partly covered segment is left out; mode="corrected" keeps it."""
    cut = _cut_corrected if mode == "corrected" else _cut
    return G.linestring(cut(G.path(g), P._c(start) * metres(unit), P._c(stop) * metres(unit)))


def chunks(g, size: float, unit: str = "kilometers", mode: str = "reference") -> Column:
    """Array of the line's consecutive pieces of a length, the last one shorter; a rest of
    under a centimetre is no piece. A kernel: each piece as an expression would walk the
    whole line again."""
    from meridia.functions import kernels

    return kernels.chunks(g, size * metres(unit), mode)


def split(g, p, mode: str = "reference") -> Column:
    """Array of the line's parts before and after a point of it (the line itself if the
    point is an end); null if the point isn't on the line. A line may come through one of
    its ends again: it is left whole, and with mode="corrected" split there."""
    path, q = G.path(g), F.slice(G.get_coord(p), 1, 2)
    n = F.size(path)
    flat = F.transform(path, lambda v: F.slice(v, 1, 2))
    vertex = F.array_position(flat, q).cast("int")
    hit = F.filter(F.transform(G.edges(path), lambda e, i: F.struct(i.alias("i"), P.on_segment(q[0], q[1], e["a"][0], e["a"][1], e["b"][0], e["b"][1]).alias("on"))), lambda s: s["on"])
    i = F.get(hit, F.lit(0))["i"]
    at_vertex = F.array(G.linestring(F.slice(path, 1, vertex)), G.linestring(F.slice(path, vertex, n - vertex + 1)))
    inside = F.array(G.linestring(F.concat(F.slice(path, 1, i + 1), F.array(q))), G.linestring(F.concat(F.array(q), F.slice(path, i + 2, n))))
    whole = F.array(G.linestring(path))
    ends = (F.element_at(flat, 1) == q) | (F.element_at(flat, -1) == q)
    if mode == "corrected":
        inner = F.array_position(F.slice(flat, 2, F.greatest(n - 2, F.lit(0))), q).cast("int")
        ends, vertex = ends & (inner == 0), F.when(inner > 0, inner + 1).otherwise(F.lit(0))
        at_vertex = F.array(G.linestring(F.slice(path, 1, vertex)), G.linestring(F.slice(path, F.greatest(vertex, F.lit(1)), n - vertex + 1)))
    return F.when(F.size(hit) == 0, F.lit(None)).when(ends, whole).when(vertex > 0, at_vertex).otherwise(inside)


def _crossing(e: Column, f: Column) -> Column:
    """Where two segments cross, ends included; null for parallel ones."""
    ux, uy, vx, vy = e["b"][0] - e["a"][0], e["b"][1] - e["a"][1], f["b"][0] - f["a"][0], f["b"][1] - f["a"][1]
    wx, wy = f["a"][0] - e["a"][0], f["a"][1] - e["a"][1]
    den = ux * vy - uy * vx
    t, s = F.try_divide(wx * vy - wy * vx, den), F.try_divide(wx * uy - wy * ux, den)
    good = (F.abs(den) >= 1e-15) & (t >= 0) & (t <= 1) & (s >= 0) & (s <= 1)
    return F.when(good, F.array(e["a"][0] + t * ux, e["a"][1] + t * uy))


def _distinct(spots: Column) -> Column:
    keyed = F.transform(spots, lambda p: F.struct(F.round(p[0], 10).alias("x"), F.round(p[1], 10).alias("y")))
    return F.transform(F.array_distinct(keyed), lambda k: F.array(k["x"], k["y"]))


def intersections(a, b) -> Column:
    """Array of the positions where the segments of two geometries cross, each once (10 decimals)."""
    spots = F.flatten(F.transform(segments(a), lambda e: F.transform(segments(b), lambda f: _crossing(e, f))))
    return _distinct(F.filter(spots, lambda p: p.isNotNull()))


def overlaps(a, b) -> Column:
    """Array of LineStrings along which segments of two lines coincide, each once whichever way it runs."""

    def shared(e: Column, f: Column) -> Column:
        ux, uy = e["b"][0] - e["a"][0], e["b"][1] - e["a"][1]
        size = ux * ux + uy * uy
        off = lambda p: F.abs((p[0] - e["a"][0]) * uy - (p[1] - e["a"][1]) * ux)
        t = lambda p: F.try_divide((p[0] - e["a"][0]) * ux + (p[1] - e["a"][1]) * uy, size)
        lo = F.greatest(F.least(t(f["a"]), t(f["b"])), F.lit(0.0))
        hi = F.least(F.greatest(t(f["a"]), t(f["b"])), F.lit(1.0))
        good = (off(f["a"]) <= 1e-10) & (off(f["b"]) <= 1e-10) & (size >= 1e-15) & (hi - lo >= 1e-15)
        spot = lambda s: F.array(F.round(e["a"][0] + s * ux, 10), F.round(e["a"][1] + s * uy, 10))
        return F.when(good, F.array_sort(F.array(spot(lo), spot(hi))))

    found = F.flatten(F.transform(segments(a), lambda e: F.transform(segments(b), lambda f: shared(e, f))))
    return F.transform(F.array_distinct(F.filter(found, lambda s: s.isNotNull())), G.linestring)


def kinks(g) -> Column:
    """Array of the positions where a path crosses itself; segments that share a vertex don't count."""

    def one(path: Column) -> Column:
        es = G.edges(path)
        apart = lambda e, f: (e["a"] != f["a"]) & (e["a"] != f["b"]) & (e["b"] != f["a"]) & (e["b"] != f["b"])
        pair = lambda e, i: F.transform(F.slice(es, i + 2, F.size(es)), lambda f: F.when(apart(e, f), _crossing(e, f)))
        return F.flatten(F.transform(es, pair))

    spots = F.flatten(F.transform(F.flatten(G._c(g)["coords"]), one))
    return _distinct(F.filter(spots, lambda p: p.isNotNull()))


def direction(g) -> Column:
    """Planar bearing in degrees from the first to the last position."""
    a, b = F.element_at(G.path(g), 1), F.element_at(G.path(g), -1)
    return F.degrees(F.atan2(b[0] - a[0], b[1] - a[1]))


def mask(outer, inner) -> Column:
    """The first polygon of ``outer`` with those rings of ``inner`` as holes (counter-clockwise)
    whose first vertex is inside."""
    shell = G.path(outer)
    holes = F.filter(F.flatten(G._c(inner)["coords"]), lambda r: Q.in_rings(r[0][0], r[0][1], F.array(shell)))
    turned = F.transform(holes, lambda r: F.when(G.clockwise(r), F.reverse(r)).otherwise(r))
    return G.polygon(F.concat(F.array(shell), turned))
