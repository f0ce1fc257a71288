"""Geodesy on plain longitude and latitude columns; every function is one Catalyst expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridia.schema import EARTH_RADIUS, angular_radians, metres

PI = math.pi


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def _rad(x) -> Column:
    return F.radians(_c(x))


def haversine(x1, y1, x2, y2) -> Column:
    """Great-circle distance in metres."""
    half_lat, half_lng = F.sin(_rad(_c(y2) - _c(y1)) / 2), F.sin(_rad(_c(x2) - _c(x1)) / 2)
    a = half_lat * half_lat + F.cos(_rad(y1)) * F.cos(_rad(y2)) * half_lng * half_lng
    return F.lit(2 * EARTH_RADIUS) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def distance(x1, y1, x2, y2, unit: str = "kilometers") -> Column:
    return haversine(x1, y1, x2, y2) / F.lit(metres(unit))


def planar_distance(x1, y1, x2, y2) -> Column:
    return F.hypot(_c(x2) - _c(x1), _c(y2) - _c(y1))


def _stretched(y: Column) -> Column:
    """The isometric latitude, null beyond the poles."""
    return F.ln(F.tan(y / 2 + PI / 4))


def _rhumb_q(lat1: Column, lat2: Column, threshold: float = 0.0) -> Column:
    step = _stretched(lat2) - _stretched(lat1)
    return F.when(F.abs(step) > threshold, F.try_divide(lat2 - lat1, step)).otherwise(F.cos(lat1))


def rhumb_distance(x1, y1, x2, y2, unit: str = "kilometers") -> Column:
    """Length of the line of constant bearing; it never crosses the antimeridian."""
    lat1, lat2, dx = _rad(y1), _rad(y2), _rad(_c(x2) - _c(x1))
    q = F.coalesce(_rhumb_q(lat1, lat2), F.cos(lat1))
    return F.sqrt((lat2 - lat1) * (lat2 - lat1) + q * q * dx * dx) * F.lit(EARTH_RADIUS / metres(unit))


def bearing(x1, y1, x2, y2) -> Column:
    """Initial great-circle bearing in [0, 360)."""
    lat1, lat2, dx = _rad(y1), _rad(y2), _rad(_c(x2) - _c(x1))
    angle = F.atan2(F.sin(dx) * F.cos(lat2), F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(dx))
    return (F.degrees(angle) + 360) % 360


def rhumb_bearing(x1, y1, x2, y2, mode: str = "reference") -> Column:
    """Bearing of the rhumb line in [0, 360). The default keeps a customary formula that
    isn't the textbook's; mode="corrected" is the textbook's."""
    lat1, lat2, dx = _rad(y1), _rad(y2), _rad(_c(x2) - _c(x1))
    if mode == "corrected":
        dx = F.when(F.abs(dx) > PI, dx - F.signum(dx) * 2 * PI).otherwise(dx)
        return (F.degrees(F.atan2(dx, _stretched(lat2) - _stretched(lat1))) + 360) % 360
    q = F.coalesce(_rhumb_q(lat1, lat2, 1e-10), F.cos(lat1))
    dx = F.when(F.abs(dx) > PI, dx - 2 * PI).otherwise(dx)
    turn = F.atan2(-q * F.sin(dx), F.cos(lat1) * F.cos(lat2) - F.sin(lat1) * F.sin(lat2) * F.cos(dx))
    return (F.degrees(turn) + 360) % 360


def angle(x1, y1, xm, ym, x2, y2) -> Column:
    """The angle at the middle point, 0 to 180 degrees."""
    turn = F.abs(bearing(xm, ym, x2, y2) - bearing(xm, ym, x1, y1))
    return F.when(turn > 180, 360 - turn).otherwise(turn)


def _wrapped(x: Column, mode: str) -> Column:
    """Into one turn: by truncation (which leaves values under -180 alone), or truly."""
    return (F.pmod(x + PI, F.lit(2 * PI)) if mode == "corrected" else (x + PI) % F.lit(2 * PI)) - PI


def destination(x, y, dist, brg, unit: str = "kilometers", mode: str = "reference") -> tuple[Column, Column]:
    """(lng, lat) of the point at a distance along a great circle."""
    d, turn, lat, lng = angular_radians(_c(dist), unit), _rad(brg), _rad(y), _rad(x)
    sin2 = F.sin(lat) * F.cos(d) + F.cos(lat) * F.sin(d) * F.cos(turn)
    lat2 = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sin2)))
    lng2 = lng + F.atan2(F.sin(turn) * F.sin(d) * F.cos(lat), F.cos(d) - F.sin(lat) * F.sin(lat2))
    return F.degrees(_wrapped(lng2, mode)), F.degrees(lat2)


def rhumb_destination(x, y, dist, brg, unit: str = "kilometers", mode: str = "reference") -> tuple[Column, Column]:
    """(lng, lat) of the point at a distance along a line of constant bearing. Due east and west
    the quotient of two rounding errors would take the place of the parallel's stretch."""
    d, turn, lat, lng = angular_radians(_c(dist), unit), _rad(brg), _rad(y), _rad(x)
    lat2 = lat + d * F.cos(turn)
    q = F.coalesce(_rhumb_q(lat, lat2, 1e-10), F.cos(lat))
    lng2 = lng + F.try_divide(d * F.sin(turn), q)
    folded = F.greatest(F.lit(-PI / 2), F.least(F.lit(PI / 2), _wrapped(lat2, mode)))
    return F.degrees(_wrapped(lng2, mode)), F.degrees(folded)


def midpoint(x1, y1, x2, y2) -> tuple[Column, Column]:
    """(lng, lat) half way along the great circle."""
    lat1, lat2, lng1, dx = _rad(y1), _rad(y2), _rad(x1), _rad(_c(x2) - _c(x1))
    east, north = F.cos(lat2) * F.cos(dx), F.cos(lat2) * F.sin(dx)
    lat = F.atan2(F.sin(lat1) + F.sin(lat2), F.sqrt((F.cos(lat1) + east) * (F.cos(lat1) + east) + north * north))
    return F.degrees(lng1 + F.atan2(north, F.cos(lat1) + east)), F.degrees(lat)


def mercator(x, y) -> tuple[Column, Column]:
    from meridia.schema import HALF_MERCATOR as H

    return _c(x) * (H / 180), F.ln(F.tan(PI / 4 + _c(y) * (PI / 360))) * (H / PI)


def wgs84(x, y) -> tuple[Column, Column]:
    from meridia.schema import HALF_MERCATOR as H

    return _c(x) * (180 / H), F.atan(F.exp(_c(y) * (PI / H))) * (360 / PI) - 90


def on_segment(px, py, ax, ay, bx, by) -> Column:
    """Whether the point is on the segment, ends included, to within 1e-10."""
    dx, dy, ex, ey = _c(bx) - _c(ax), _c(by) - _c(ay), _c(px) - _c(ax), _c(py) - _c(ay)
    dot = ex * dx + ey * dy
    return (F.abs(ex * dy - ey * dx) <= 1e-10) & (dot >= 0) & (dot - (dx * dx + dy * dy) <= 1e-10)


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether two segments share a point; parallel ones when one's end is on the other."""
    ux, uy, vx, vy = _c(bx) - _c(ax), _c(by) - _c(ay), _c(dx) - _c(cx), _c(dy) - _c(cy)
    wx, wy = _c(cx) - _c(ax), _c(cy) - _c(ay)
    den = ux * vy - uy * vx
    inside = lambda t: (t >= -1e-10) & (t <= 1 + 1e-10)
    crossing = inside(F.try_divide(wx * vy - wy * vx, den)) & inside(F.try_divide(wx * uy - wy * ux, den))
    touching = on_segment(cx, cy, ax, ay, bx, by) | on_segment(dx, dy, ax, ay, bx, by) | on_segment(ax, ay, cx, cy, dx, dy) | on_segment(bx, by, cx, cy, dx, dy)
    return F.when(F.abs(den) < 1e-10, touching).otherwise(crossing)


def plane_z(px, py, a: tuple, b: tuple, c: tuple, mode: str = "reference") -> Column:
    """Height at a point of the plane through three (x, y, z) corners. By default the
    weights of the second and third corner are exchanged, as is customary."""
    (ax, ay, az), (bx, by, bz), (cx, cy, cz) = ([_c(v) for v in p] for p in (a, b, c))
    den = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
    wa = F.try_divide((by - cy) * (_c(px) - cx) + (cx - bx) * (_c(py) - cy), den)
    wb = F.try_divide((cy - ay) * (_c(px) - cx) + (ax - cx) * (_c(py) - cy), den)
    wc = 1 - wa - wb
    return wa * az + (wb * bz + wc * cz if mode == "corrected" else wc * bz + wb * cz)


def box_distance(px, py, minx, miny, maxx, maxy) -> Column:
    """Planar distance from a point to a box, 0 inside."""
    zero = F.lit(0.0)
    return F.hypot(F.greatest(_c(minx) - _c(px), zero, _c(px) - _c(maxx)), F.greatest(_c(miny) - _c(py), zero, _c(py) - _c(maxy)))
