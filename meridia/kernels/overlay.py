"""Polygon overlay by arrangement: union, intersection, difference, symmetric difference
and repair of any number of regions at once.

All edges are split where they meet. A piece belongs to the result's boundary when the
regions on its left and right give different answers, and is directed so that the
result lies on its left; pieces are then joined into rings, always by the next piece
clockwise, so that parts that touch in a point stay apart. Holes, collinear edges and
common vertices need no special cases.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

import numpy as np

Ring = list
DIGITS = 11
#: Up to so many edges plain loops are faster than arrays.
SMALL = 32
EPS = 1e-12


def signed_area(ring: Ring) -> float:
    if len(ring) <= SMALL:
        return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2 if len(ring) > 2 else 0.0
    a = np.asarray([p[:2] for p in ring], float)
    if len(a) < 3:
        return 0.0
    b = np.roll(a, -1, 0)
    return float((a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]).sum() / 2)


def closed(ring: Ring) -> Ring:
    ring = [list(p[:2]) for p in ring]
    return ring if ring and ring[0] == ring[-1] else ring + ring[:1]


def ring_edges(rings: list[Ring]) -> np.ndarray:
    """(n, 4) array of x1, y1, x2, y2."""
    out = [np.column_stack([r[:-1], r[1:]]) for r in (np.asarray(closed(r), float) for r in rings if len(r) > 2)]
    edges = np.concatenate(out) if out else np.zeros((0, 4))
    return edges[(edges[:, 0] != edges[:, 2]) | (edges[:, 1] != edges[:, 3])]


def inside(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Even-odd test of many points against many edges."""
    out = np.zeros(len(points), bool)
    for s in range(0, len(points), 2048):
        x, y = points[s : s + 2048, :1], points[s : s + 2048, 1:2]
        x1, y1, x2, y2 = edges.T
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (x2 - x1) * (y - y1) / (y2 - y1) + x1
        out[s : s + 2048] = (((y1 > y) != (y2 > y)) & (x < at)).sum(1) % 2 == 1
    return out


def split_edges(edges: np.ndarray) -> list[np.ndarray]:
    """For each edge the sorted positions along it (0 to 1) where other edges meet it."""
    marks = [[0.0, 1.0] for _ in edges]
    size = np.hypot(edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1])
    eps = EPS
    for k, (x, y, x2, y2) in enumerate(edges):
        ux, uy = x2 - x, y2 - y
        near = np.flatnonzero((np.minimum(edges[:, 0], edges[:, 2]) <= max(x, x2) + eps) & (np.maximum(edges[:, 0], edges[:, 2]) >= min(x, x2) - eps) & (np.minimum(edges[:, 1], edges[:, 3]) <= max(y, y2) + eps) & (np.maximum(edges[:, 1], edges[:, 3]) >= min(y, y2) - eps))
        near = near[near != k]
        if not len(near):
            continue
        a, b = edges[near, :2], edges[near, 2:]
        v = b - a
        w = a - (x, y)
        den = ux * v[:, 1] - uy * v[:, 0]
        flat = np.abs(den) <= 1e-14 * size[k] * size[near]
        safe = np.where(flat, 1.0, den)
        t = (w[:, 0] * v[:, 1] - w[:, 1] * v[:, 0]) / safe
        u = (w[:, 0] * uy - w[:, 1] * ux) / safe
        good = ~flat & (t > -eps) & (t < 1 + eps) & (u > -eps) & (u < 1 + eps)
        marks[k] += t[good].tolist()
        for p in (a, b):  # ends of other edges that lie on this one
            d = p - (x, y)
            off = np.abs(d[:, 0] * uy - d[:, 1] * ux) / size[k]
            s = (d[:, 0] * ux + d[:, 1] * uy) / size[k] ** 2
            marks[k] += s[(off < 1e-11) & (s > eps) & (s < 1 - eps)].tolist()
    return [np.unique(np.clip(m, 0, 1)) for m in marks]


def _few_inside(x: float, y: float, edges: list) -> bool:
    """As ``inside``, for one point and few edges."""
    odd = False
    for x1, y1, x2, y2 in edges:
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def _few_split(edges: list) -> list[list[float]]:
    """As ``split_edges``, for few edges."""
    size = [math.hypot(c - a, d - b) for a, b, c, d in edges]
    spans = [(a, c) if a < c else (c, a) for a, _, c, _ in edges], [(b, d) if b < d else (d, b) for _, b, _, d in edges]
    marks = []
    for k, (x, y, x2, y2) in enumerate(edges):
        ux, uy = x2 - x, y2 - y
        lo_x, hi_x, lo_y, hi_y = spans[0][k][0] - EPS, spans[0][k][1] + EPS, spans[1][k][0] - EPS, spans[1][k][1] + EPS
        own = {0.0, 1.0}
        for j, (ax, ay, bx, by) in enumerate(edges):
            (west, east), (south, north) = spans[0][j], spans[1][j]
            if j == k or west > hi_x or east < lo_x or south > hi_y or north < lo_y:
                continue
            vx, vy, wx, wy = bx - ax, by - ay, ax - x, ay - y
            den = ux * vy - uy * vx
            if abs(den) > 1e-14 * size[k] * size[j]:
                t, u = (wx * vy - wy * vx) / den, (wx * uy - wy * ux) / den
                if -EPS < t < 1 + EPS and -EPS < u < 1 + EPS:
                    own.add(min(max(t, 0.0), 1.0))
            for dx, dy in ((wx, wy), (bx - x, by - y)):
                s = (dx * ux + dy * uy) / size[k] ** 2
                if EPS < s < 1 - EPS and abs(dx * uy - dy * ux) / size[k] < 1e-11:
                    own.add(s)
        marks.append(sorted(own))
    return marks


def overlay(regions: list[list[Ring]], keep: Callable[[np.ndarray], np.ndarray]) -> list[list[Ring]]:
    """Polygons (exterior counter-clockwise, holes clockwise, closed) of the points for
    which ``keep`` is true. A region is a list of rings under the even-odd rule; ``keep``
    takes a (points, regions) matrix of booleans."""
    if sum(len(r) for rings in regions for r in rings) <= SMALL:
        return _few_overlay(regions, keep)
    per = [ring_edges(r) for r in regions]
    edges = np.concatenate(per) if per else np.zeros((0, 4))
    if not len(edges):
        return []
    pieces: dict[tuple, None] = {}
    for (x, y, x2, y2), ts in zip(edges.tolist(), split_edges(edges), strict=True):
        at = [(round(x + (x2 - x) * t, DIGITS) + 0.0, round(y + (y2 - y) * t, DIGITS) + 0.0) for t in ts.tolist()]
        for p, q in zip(at[:-1], at[1:], strict=True):
            if p != q:
                pieces[(p, q) if p < q else (q, p)] = None
    if not pieces:
        return []
    p, q = np.array([a for a, _ in pieces]), np.array([b for _, b in pieces])
    d = q - p
    normal = np.column_stack([-d[:, 1], d[:, 0]]) * 1e-6
    left = np.column_stack([inside((p + q) / 2 + normal, e) for e in per])
    right = np.column_stack([inside((p + q) / 2 - normal, e) for e in per])
    on_left, on_right = keep(left), keep(right)
    directed = [(a, b) if lft else (b, a) for (a, b), lft, rgt in zip(pieces, on_left.tolist(), on_right.tolist(), strict=True) if lft != rgt]
    return nested(rings_of(directed))


def _few_overlay(regions: list[list[Ring]], keep: Callable[[np.ndarray], np.ndarray]) -> list[list[Ring]]:
    per = []
    for rings in regions:
        loops = [closed(r) for r in rings if len(r) > 2]
        per.append([(float(a[0]), float(a[1]), float(b[0]), float(b[1])) for r in loops for a, b in zip(r[:-1], r[1:], strict=True) if a != b])
    edges = [e for own in per for e in own]
    pieces: dict[tuple, None] = {}
    for (x, y, x2, y2), ts in zip(edges, _few_split(edges), strict=True):
        at = [(round(x + (x2 - x) * t, DIGITS) + 0.0, round(y + (y2 - y) * t, DIGITS) + 0.0) for t in ts]
        for p, q in zip(at[:-1], at[1:], strict=True):
            if p != q:
                pieces[(p, q) if p < q else (q, p)] = None
    if not pieces:
        return []
    rows = []
    for side in (1e-6, -1e-6):
        for (px, py), (qx, qy) in pieces:
            x, y = (px + qx) / 2 - (qy - py) * side, (py + qy) / 2 + (qx - px) * side
            rows.append([_few_inside(x, y, own) for own in per])
    kept = keep(np.array(rows, bool)).tolist()
    directed = [(a, b) if lft else (b, a) for (a, b), lft, rgt in zip(pieces, kept[: len(pieces)], kept[len(pieces) :], strict=True) if lft != rgt]
    return nested(rings_of(directed))


def rings_of(directed: list[tuple]) -> list[Ring]:
    """Closed rings from directed pieces: at a vertex the next piece clockwise from the one arriving."""
    leaving = defaultdict(list)
    for a, b in directed:
        leaving[a].append((math.atan2(b[1] - a[1], b[0] - a[0]), b))
    unused = set(directed)
    out = []
    for first in directed:
        if first not in unused:
            continue
        ring, now = [first[0]], first
        while now in unused:
            unused.discard(now)
            a, b = now
            ring.append(b)
            back = math.atan2(a[1] - b[1], a[0] - b[0])
            options = [(((back - w) % (2 * math.pi)) or 2 * math.pi, y) for w, y in leaving[b]]
            if not options:
                break
            now = (b, min(options)[1])
        if len(ring) > 3 and ring[0] == ring[-1]:
            out.append([list(v) for v in ring])
    return out


def nested(rings: list[Ring]) -> list[list[Ring]]:
    """Rings into polygons: clockwise ones are holes of the smallest exterior around them."""
    areas = [signed_area(r) for r in rings]
    shells = sorted((k for k, a in enumerate(areas) if a > 0), key=lambda k: areas[k])
    polygons = {k: [simplified(rings[k])] for k in shells}
    for k, a in enumerate(areas):
        if a >= 0:
            continue
        ring = rings[k]
        mid = np.array([[(ring[0][0] + ring[1][0]) / 2, (ring[0][1] + ring[1][1]) / 2]])
        d = np.array([ring[1][1] - ring[0][1], ring[0][0] - ring[1][0]]) * -1e-6  # to the ring's left: the result's side
        for s in shells:
            if areas[s] > -a * (1 - 1e-9) and inside(mid + d, ring_edges([rings[s]]))[0]:
                polygons[s].append(simplified(ring))
                break
    return [polygons[k] for k in sorted(shells)]


def simplified(ring: Ring) -> Ring:
    """Without vertices in the middle of straight edges."""
    pts, out = ring[:-1], []
    n = len(pts)
    for k in range(n):
        a, b, c = pts[k - 1], pts[k], pts[(k + 1) % n]
        cross = (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])
        if abs(cross) > 1e-13 * max(1e-12, math.hypot(b[0] - a[0], b[1] - a[1]) * math.hypot(c[0] - b[0], c[1] - b[1])) ** 0.5:
            out.append(b)
    return out + out[:1] if len(out) >= 3 else ring


def _region(geometry: dict) -> list[list[Ring]]:
    """The polygons of a geometry as regions of their own, so that overlaps don't cancel."""
    return [p for p in geometry["coords"] if p]


def as_geometry(polygons: list[list[Ring]]) -> dict | None:
    if not polygons:
        return None
    return {"type": "Polygon" if len(polygons) == 1 else "MultiPolygon", "coords": polygons}


def _apart(ra: list[list[Ring]], rb: list[list[Ring]]) -> bool:
    """Whether the boxes of two sets of regions leave a gap, wider than the overlay's reach."""
    boxes = []
    for regions in (ra, rb):
        xs, ys = [p[0] for g in regions for r in g for p in r], [p[1] for g in regions for r in g for p in r]
        if not xs:
            return False
        boxes.append((min(xs), min(ys), max(xs), max(ys)))
    (ax, ay, ax2, ay2), (bx, by, bx2, by2) = boxes
    reach = 1e-9 + 1e-5 * max(ax2 - ax, ay2 - ay, bx2 - bx, by2 - by)
    return max(bx - ax2, ax - bx2, by - ay2, ay - by2) > reach


def _alone(regions: list[list[Ring]]) -> list[list[Ring]]:
    """The union of a set of regions; one convex ring is only turned counter-clockwise."""
    if len(regions) == 1 and len(regions[0]) == 1 and 3 < len(regions[0][0]) <= SMALL:
        pts = [(round(p[0], DIGITS) + 0.0, round(p[1], DIGITS) + 0.0) for p in closed(regions[0][0])[:-1]]
        ahead = pts[1:] + pts[:1]
        ways = [(q[0] - p[0], q[1] - p[1]) for p, q in zip(pts, ahead, strict=True)]
        turns = [u[0] * v[1] - u[1] * v[0] for u, v in zip(ways, ways[1:] + ways[:1], strict=True)]
        signs = [w[0] > 0 for w in ways if w[0]]
        swings = sum(u != v for u, v in zip(signs, signs[1:] + signs[:1], strict=True))
        if swings == 2 and (min(turns) > 1e-6 or max(turns) < -1e-6):
            ring = pts + pts[:1] if turns[0] > 0 else [pts[1], pts[0], *pts[:0:-1]]
            return [[[list(p) for p in ring]]]
    return overlay(regions, lambda m: m.any(1))


def combine(a: dict, b: dict, operation: str) -> dict | None:
    """union, intersect, difference or xor of two areal geometries; None when nothing is left."""
    ra, rb = _region(a), _region(b)
    n = len(ra)
    if operation in ("union", "intersect", "difference", "xor") and _apart(ra, rb):
        alone = {"union": (ra, rb), "intersect": (), "difference": (ra,), "xor": (ra, rb)}[operation]
        return as_geometry([p for rs in alone for p in _alone(rs)])
    rules = {"union": np.logical_or, "intersect": np.logical_and, "difference": lambda x, y: x & ~y, "xor": np.logical_xor}
    rule = rules[operation]
    return as_geometry(overlay(ra + rb, lambda m: rule(m[:, :n].any(1), m[:, n:].any(1))))


def union_all(geometries: list[dict]) -> dict | None:
    """The union of any number of areal geometries in one overlay."""
    return as_geometry(overlay([r for g in geometries for r in _region(g)], lambda m: m.any(1)))


def unkinked(geometry: dict) -> list[dict]:
    """Simple polygons covering what the geometry's rings enclose under the even-odd rule."""
    return [{"type": "Polygon", "coords": [p]} for p in overlay([[r for p in geometry["coords"] for r in p]], lambda m: m[:, 0])]
