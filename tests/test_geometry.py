"""Geometry columns, predicates, lines, kernels, joins and collections."""

import inspect
import json
import random

import pytest
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions import kernels as K
from meridia.functions import lines as L
from meridia.functions import predicates as Q
from meridia.kernels import overlay, planar
from meridia.operators import aggregates, clusters, generators, graph, index, joins, stats, surfaces
from meridia.schema import GEOM, GEOM_DDL
from meridia.sources import geojson


def ring(*ps):
    return [[float(v) for v in p] for p in ps]


def box(a, b, c, d):
    return ("Polygon", [[ring((a, b), (c, b), (c, d), (a, d), (a, b))]])


def line(*ps):
    return ("LineString", [[ring(*ps)]])


def pt(*p):
    return ("Point", [[ring(p)]])


def one(spark, f, *geoms):
    """``f`` over literal geometries."""
    names = [f"g{k}" for k in range(len(geoms))]
    df = spark.createDataFrame([geoms], ", ".join(f"{n} {GEOM_DDL}" for n in names))
    return df.select(f(*names).alias("v")).first().v


def features(spark, rows):
    return spark.createDataFrame([(i, g) for i, g in enumerate(rows)], f"fid long, geom {GEOM_DDL}")


SQUARE = box(0, 0, 10, 10)
HOLED = ("Polygon", [[*SQUARE[1][0], ring((3, 3), (7, 3), (7, 7), (3, 7), (3, 3))]])


def test_centres(spark):
    assert one(spark, G.centroid, SQUARE).coords[0][0][0] == [4.0, 4.0]
    assert one(spark, G.center, SQUARE).coords[0][0][0] == [5.0, 5.0]
    assert one(spark, lambda g: G.center_of_mass(g, "corrected"), SQUARE).coords[0][0][0] == pytest.approx([5.0, 5.0])


def test_area_of_the_world(spark):
    world = box(-180, -90, 180, 90)
    assert one(spark, G.area, world) == pytest.approx(5.1e14, rel=0.01)
    assert one(spark, G.area, line((0, 0), (1, 1))) == 0


INNER, ASIDE, ACROSS = box(1, 1, 9, 9), box(10, 0, 20, 10), line((-5, 5), (15, 5))
PREDICATES = {
    "point_in_polygon": (Q.point_in_polygon, [(pt(5, 5), SQUARE, True), (pt(20, 20), SQUARE, False), (pt(0, 5), SQUARE, True), (pt(5, 5), HOLED, False), (pt(3, 5), HOLED, True)]),
    "contains": (Q.contains, [(SQUARE, INNER, True), (INNER, SQUARE, False), (SQUARE, pt(5, 5), True), (ACROSS, pt(0, 5), True), (SQUARE, ACROSS, False)]),
    "intersects": (Q.intersects, [(SQUARE, INNER, True), (INNER, SQUARE, False), (SQUARE, box(20, 20, 30, 30), False), (ACROSS, SQUARE, True), (pt(0, 0), SQUARE, True)]),
    "corrected": (lambda a, b: Q.intersects(a, b, "corrected"), [(INNER, SQUARE, True), (line((2, 2), (3, 3)), SQUARE, True)]),
    "touches": (Q.touches, [(SQUARE, ASIDE, True), (pt(0, 0), SQUARE, False), (SQUARE, INNER, False)]),
    "overlap": (Q.overlap, [(SQUARE, box(5, 5, 15, 15), True), (SQUARE, ACROSS, False)]),
    "crosses": (Q.crosses, [(SQUARE, ACROSS, True), (pt(0, 0), pt(0, 0), False)]),
    "on_line": (lambda p, g: Q.point_on_line(p, g, True), [(pt(5, 0), line((0, 0), (10, 0)), True), (pt(0, 0), line((0, 0), (10, 0)), False)]),
    "equal": (Q.equal, [(("MultiPoint", line((0, 0), (1, 1))[1]), line((0, 0), (1, 1)), True), (SQUARE, INNER, False)]),
    "valid": (lambda a, b: Q.valid(a), [(("Polygon", [[ring((0, 0), (1, 0), (0, 0))]]), SQUARE, False), (SQUARE, SQUARE, True)]),
}


@pytest.mark.parametrize("name", PREDICATES)
def test_predicates(spark, name):
    f, cases = PREDICATES[name]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], f"k int, a {GEOM_DDL}, b {GEOM_DDL}")
    assert [r.v for r in df.select("k", f("a", "b").alias("v")).orderBy("k").collect()] == [want for *_, want in cases]


def test_transforms(spark):
    assert one(spark, lambda g: G.rotate(g, 90.0, (0.0, 0.0)), pt(1, 0)).coords[0][0][0] == pytest.approx([0, 1])
    assert one(spark, G.flip, pt(1, 2, 3)).coords[0][0][0] == [2.0, 1.0, 3.0]
    assert one(spark, lambda g: G.truncate(g, 1, 2), pt(-1.25, 2.35, 9)).coords[0][0][0] == pytest.approx([-1.3, 2.4])
    assert one(spark, G.clean_coords, line((0, 0), (0, 0), (1, 1), (1, 1))).coords[0][0] == ring((0, 0), (1, 1))
    turned = one(spark, G.rewind, ("Polygon", [[ring((0, 0), (2, 0), (1, 1), (0, 0))]])).coords[0][0]
    assert turned == ring((0, 0), (1, 1), (2, 0), (0, 0))
    assert len(one(spark, lambda g: G.bezier_spline(g, resolution=50), line((0, 0), (1, 1), (2, 0))).coords[0][0]) == 51
    assert one(spark, G.line_to_polygon, line((0, 0), (1, 0), (1, 1))).coords[0][0][-1] == [0.0, 0.0]


def test_lines(spark):
    g = line((0, 0), (10, 0))
    near = one(spark, L.nearest_point_on_line, g, pt(5, 1))
    assert (near["index"], near.x, near.y) == (0, pytest.approx(5), pytest.approx(0))
    assert one(spark, lambda a: L.along(a, 1e9), g).coords[0][0][0] == [10.0, 0.0]
    assert len(one(spark, lambda a: L.chunks(a, 300.0), g)) == 4
    assert len(one(spark, L.split, g, pt(4, 0))) == 2 and one(spark, L.split, g, pt(4, 1)) is None and len(one(spark, L.split, g, pt(0, 0))) == 1
    assert one(spark, L.intersections, g, line((5, -5), (5, 5))) == [[5.0, 0.0]]
    assert one(spark, L.kinks, ("Polygon", [[ring((0, 0), (10, 10), (10, 0), (0, 10), (0, 0))]])) == [[5.0, 5.0]]
    assert len(one(spark, L.overlaps, g, line((12, 0), (4, 0)))) == 1
    assert one(spark, L.point_to_polygon, pt(5, 5), SQUARE) == 0 and one(spark, L.point_to_polygon, pt(5, 12), SQUARE) > 200
    assert len(one(spark, L.mask, box(-20, -20, 20, 20), SQUARE).coords[0]) == 2


def area(g):
    return sum(overlay.signed_area(r) for p in g["coords"] for r in p) if g else 0.0


def geo(g):
    return {"type": g[0], "coords": g[1]}


def test_clipping_literals():
    a, b = geo(box(0, 0, 2, 2)), geo(box(1, 1, 3, 3))
    got = {k: area(overlay.combine(a, b, k)) for k in ("union", "intersect", "difference", "xor")}
    assert got == {"union": 7, "intersect": 1, "difference": 3, "xor": 6}
    hole = overlay.combine(geo(box(0, 0, 5, 5)), geo(box(1, 1, 4, 4)), "difference")["coords"]
    assert [abs(overlay.signed_area(r)) for r in hole[0]] == [25, 9]
    touching = overlay.combine(geo(box(0, 0, 1, 1)), geo(box(1, 0, 2, 1)), "union")
    assert len(touching["coords"]) == 1 and area(touching) == 2
    assert overlay.combine(a, geo(box(5, 5, 6, 6)), "intersect") is None and overlay.combine(a, a, "difference") is None


def test_clipping_identities():
    rnd = random.Random(5)
    for _ in range(40):
        a, b = (planar.convex_hull([[rnd.uniform(0, 4), rnd.uniform(0, 4)] for _ in range(8)]) for _ in range(2))
        u, i, d, x = (area(overlay.combine(a, b, k)) for k in ("union", "intersect", "difference", "xor"))
        assert u + i == pytest.approx(area(a) + area(b), abs=1e-7) and d == pytest.approx(area(a) - i, abs=1e-7) and x == pytest.approx(u - i, abs=1e-7)


def test_kernels(spark):
    assert len(overlay.unkinked({"coords": [[ring((0, 0), (10, 10), (10, 0), (0, 10), (0, 0))]]})) == 2
    grown = planar.buffer(geo(line((0, 0), (1, 0), (1, 1))), 0.1, "degrees")
    assert len(grown["coords"]) == 1 and 0.4 < area(grown) < 0.44
    assert len(planar.tessellate(geo(box(0, 0, 1, 1)))) == 2
    assert len(planar.simplify_path([[x, 0.001 * (x % 2)] for x in range(100)], 0.1)) == 2
    clip = planar.box_clip(geo(line((-5, 5), (15, 5))), [0, 0, 10, 10], "corrected")
    assert clip["coords"][0][0] == [[0.0, 5.0], [10.0, 5.0]] and planar.box_clip(geo(line((-5, 5), (15, 5))), [0, 0, 10, 10]) is None
    assert planar.tangents([0, 0], geo(box(5, -1, 7, 1))) == [[5.0, 1.0], [5.0, -1.0]]
    moved = planar.line_offset(geo(line((0, 0), (0, 1))), 111.2, "kilometers")["coords"][0][0]
    assert moved[0][0] > 0.9, "to the right of the way north"
    with pytest.raises(ValueError):
        K.simplify("geom", 0)


def test_delaunay_circles_are_empty():
    import numpy as np

    xy = np.random.default_rng(2).uniform(0, 10, (60, 2))
    tri = planar.delaunay(xy)
    for t in tri:
        a, b, c = xy[t]
        m = 2 * np.array([b - a, c - a])
        mid = np.linalg.solve(m, [(b @ b - a @ a), (c @ c - a @ a)])
        assert (np.hypot(*(xy - mid).T) >= np.hypot(*(a - mid)) - 1e-9).all()
    assert sum(abs(overlay.signed_area(xy[t].tolist())) for t in tri) == pytest.approx(area(planar.convex_hull(xy.tolist())))


def points(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y), float(z[0]) if z else None) for i, (x, y, *z) in enumerate(rows)], "fid long, lng double, lat double, z double")


def test_joins(spark):
    zones = spark.createDataFrame([(1, "a", box(0, 0, 5, 5)), (2, "b", box(3, 3, 8, 8)), (3, "far", box(-170, -80, 170, 80))], f"zid long, zone string, geom {GEOM_DDL}")
    pts = points(spark, [(1, 1), (4, 4), (7, 7), (179, 85)])
    for strategy in ("broadcast", "cells"):
        assert {r.fid: r.tag for r in joins.tag(pts, zones, "zone", "tag", strategy).collect()} == {0: "a", 1: "a", 2: "b", 3: None}
    got = {r.zid: r.vs for r in joins.collect(zones, pts.withColumn("z", F.col("fid").cast("double")), "z", "vs").collect()}
    assert got == {1: [0.0, 1.0], 2: [1.0, 2.0], 3: [0.0, 1.0, 2.0]}
    assert joins.tag(pts.limit(0), zones, "zone", "tag").count() == 0 and joins.collect(zones, pts.limit(0), "z", "vs").filter("size(vs) = 0").count() == 3


def test_cells_agree_with_broadcast(spark):
    rnd = random.Random(1)
    pts = points(spark, [(rnd.uniform(-20, 20), rnd.uniform(-20, 20)) for _ in range(300)])
    polys = spark.createDataFrame([(k, (lambda h: (h["type"], h["coords"]))(planar.convex_hull([[rnd.uniform(-20, 20) * s, rnd.uniform(-20, 20) * s] for _ in range(6)]))) for k, s in enumerate([0.05, 0.3, 1.0, 1.0, 0.6])], f"zid long, geom {GEOM_DDL}")
    pair = lambda s: sorted(tuple(r) for r in joins.point_polygon_pairs(pts.select("fid", "lng", "lat"), polys, strategy=s).select("fid", "zid").collect())
    assert pair("cells") == pair("broadcast") and pair("cells")


def test_collections(spark):
    fs = features(spark, [pt(0, 0), line((0, 0), (2, 2)), SQUARE])
    assert tuple(aggregates.bbox(fs).first()) == (0, 0, 10, 10)
    assert tuple(aggregates.counts(fs).first()) == (8, 3, 3)
    assert tuple(aggregates.first_coord(fs).first()) == (0, 0)
    med = points(spark, [(0, 10), (0, 20), (0, 30)])
    assert aggregates.center_median(med).first().lat == 20 and tuple(aggregates.center_median(med.limit(0)).first()) == (0, 0)
    assert aggregates.center_mean(med.limit(0)).first().lng is None
    assert aggregates.convex_hull(features(spark, [pt(0, 0), pt(4, 0), pt(4, 4), pt(0, 4), pt(2, 2)])).first().geom.type == "Polygon"
    two = features(spark, [box(0, 0, 5, 5), box(5, 0, 10, 5)]).withColumn("k", F.lit("x"))
    assert aggregates.dissolve(two, "k").count() == 1


def test_clusters(spark):
    blobs = points(spark, [(0, 0), (1, 0), (0, 1), (10, 10), (11, 10), (10, 11), (50, 50)])
    got = {r.fid: r.cluster for r in clusters.dbscan(blobs.select("fid", "lng", "lat"), 2.0, 2).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: 0}
    assert clusters.kmeans(blobs.select("fid", "lng", "lat"), 3).select("cluster").distinct().count() == 3
    row = points(spark, [(x, 0) for x in range(5)]).select("fid", "lng", "lat")
    assert [r.cluster for r in clusters.dbscan(row, 2.0, 2).orderBy("fid").collect()] == [1] * 5
    assert [r.cluster for r in clusters.dbscan_one_hop(row, 2.0, 2).orderBy("fid").collect()] == [1, 1, 1, 2, 2]


def test_network(spark):
    net = features(spark, [line((0, 0), (5, 0), (10, 0), (10, 10)), line((0, 0), (0, 10), (10, 10))])
    got = graph.shortest_path(net, (0.1, 0), (10, 9.9)).first()
    assert got.cost == pytest.approx(20) and got.geom.coords[0][0][0] == [0.0, 0.0]
    assert graph.shortest_path(net, (0, 0), (50, 50), max_distance=1).count() == 0
    apart = features(spark, [line((0, 0), (1, 0)), line((5, 5), (6, 5))])
    assert graph.shortest_path(apart, (0, 0), (6, 5)).count() == 0


def test_statistics(spark):
    quad = stats.quadrat_analysis(points(spark, [(0, 0), (10, 0), (0, 10), (10, 10), (5, 5)]), 3).first()
    assert quad.chi2 == pytest.approx(4) and quad.df == 8 and 0 <= quad.p <= 1
    assert stats.chi_square_p(4, 8) == pytest.approx(0.572, abs=1e-3) and stats.chi_square_p(4, 8, "corrected") == pytest.approx(0.857, abs=1e-3)
    near = stats.nearest_neighbor_analysis(points(spark, [(0, 0), (0.1, 0), (0, 0.1), (9, 9), (9.1, 9)])).first()
    assert near.ratio > 0 and near.z < 0
    assert stats.moran_index(points(spark, [(0, 0, 10), (1, 0, 10), (0, 1, 10), (10, 10, 0)]), "z").first().i is not None
    assert {(r.i, r.j): r.w for r in stats.distance_weight(points(spark, [(0, 0), (2, 0), (9, 0)]), 3.0).collect()} == {(0, 1): 0.5, (1, 0): 0.5}
    sde = stats.standard_deviational_ellipse(points(spark, [(0, 0), (10, 0), (0, 10), (10, 10)])).first()
    assert (sde.lng, sde.lat) == (5, 5)


def test_surfaces(spark):
    lattice = points(spark, [(x, y, 3 * x + y) for x in range(3) for y in range(3)])
    assert surfaces.tin(lattice, "z").count() == 8
    cells = surfaces.voronoi(points(spark, [(0, 0), (1, 0), (0, 1), (1, 1)]), (-1, -1, 2, 2)).collect()
    assert len(cells) == 4 and sum(abs(overlay.signed_area(c.geom.coords[0][0])) for c in cells) == pytest.approx(9)
    assert surfaces.isolines(lattice, [3.0, 6.0]).count() >= 1 and surfaces.isobands(lattice, [0.0, 3.0, 6.0, 10.0]).count() >= 1
    exact = surfaces.interpolate(lattice, 1, "degrees").filter("x = 0 and y = 0").first()
    assert exact.z == 0
    assert surfaces.polygonize(features(spark, [line((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))])).count() == 1


def test_generators(spark):
    assert generators.point_grid(spark, (0, -5, 10, 5), 1, "degrees").count() == 11 * 11
    assert generators.hex_grid(spark, (0, 0, 0, 0), 1).count() == 1
    assert generators.flatten(features(spark, [("MultiPoint", [[ring((0, 0), (1, 1))]]), pt(2, 2)])).count() == 3
    with pytest.raises(ValueError):
        generators.square_grid(spark, (0, 0), 1)


def test_index(spark, tmp_path):
    fs = features(spark, [box(0, 0, 1, 1), box(5, 5, 6, 6), pt(3, 3)])
    index.load(fs, str(tmp_path / "index"))
    kept = spark.read.parquet(str(tmp_path / "index"))
    assert {r.fid for r in index.search(kept, (0, 0, 3, 3)).collect()} == {0, 2} and index.search(kept, (0, 0)).count() == 0
    assert [r.fid for r in index.nearest(kept, 4.0, 4.0, 2).collect()] == [1, 2]
    assert index.remove(kept, spark.createDataFrame([(0,)], "fid long")).count() == 2 and index.insert(kept, features(spark, [pt(9, 9)])).count() == 4


DOCUMENTS = [
    '{"type":"Point","coordinates":[1,2]}',
    '{"type":"Feature","id":"a","geometry":null,"properties":{"n":"5","m":3}}',
    '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]},"properties":{"k":1.5}},{"type":"Feature","geometry":{"type":"MultiLineString","coordinates":[[[0,0],[1,1]],[[2,2],[3,3]]]},"properties":{}}]}',
    '{"type":"Feature","geometry":{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,1]},{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[2,2]}]}]},"properties":{}}',
]


def test_geojson(spark, tmp_path):
    docs = spark.createDataFrame([(d,) for d in DOCUMENTS], "value string")
    rows = geojson.from_json_column(docs)
    assert [r.geom.type if r.geom else None for r in rows.orderBy("fid").collect()] == ["Point", None, "Polygon", "MultiLineString", None]
    assert rows.filter("id = 'a'").select(geojson.number("props", "n"), geojson.number("props", "m")).first()[:] == (None, 3.0)
    assert sorted((list(r.path), r.geom.coords[0][0][0]) for r in geojson.members(rows).filter("size(path) > 0").collect()) == [([0], [1.0, 1.0]), ([1, 0], [2.0, 2.0])]
    geojson.write_geojson(rows.filter("geom is not null"), str(tmp_path / "out"))
    back = geojson.read_geojson(spark, str(tmp_path / "out"), lines=True)
    assert back.count() == 3 and back.select("fid").distinct().count() == 3
    whole = json.loads(geojson.collection_json(rows))
    assert len(whole["features"]) == 5 and whole["features"][1]["geometry"] is None


def test_schema_is_uniform(spark):
    assert features(spark, [SQUARE]).schema["geom"].dataType.simpleString() == GEOM.simpleString()


@pytest.mark.parametrize("op", ["union", "intersect", "difference", "xor"])
def test_overlay_of_few_edges_and_of_regions_apart(op, monkeypatch):
    """Few edges give what arrays of them give, and regions apart aren't laid over each other."""
    turned = lambda *b: geo(("Polygon", [[box(*b)[1][0][0][::-1]]]))
    kinked = geo(("Polygon", [[ring((0.3, 0.1), (6, 5), (6, 0.5), (0, 5), (0.3, 0.1))]]))
    shapes = [geo(box(0, 0, 4, 4)), turned(1, 1, 5, 3), geo(box(4, 0, 8, 4)), kinked, turned(20, 0, 22, 1)]
    pairs = [(a, b) for a in shapes for b in shapes]
    few = [overlay.combine(a, b, op) for a, b in pairs]
    with monkeypatch.context() as m:
        m.setattr(overlay, "SMALL", 0)
        m.setattr(overlay, "_apart", lambda *_: False)
        assert few == [overlay.combine(a, b, op) for a, b in pairs]
    monkeypatch.setattr(overlay, "overlay", lambda *_: pytest.fail("laid over each other"))
    assert area(overlay.combine(shapes[0], shapes[4], op)) == {"union": 18, "intersect": 0, "difference": 16, "xor": 18}[op]


def test_great_circle_evaluates_the_arc_once(spark):
    """its length was evaluated eight times and more for every position."""
    g = L.great_circle("a", "b", "c", "d", n=5)
    rows = spark.createDataFrame([(0.0, 0.0, 90.0, 0.0), (10.0, 20.0, 10.0, 20.0)], "a double, b double, c double, d double")
    plan = rows.select(g.alias("g"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("asin(") == 1
    (arc,), (none,) = rows.select(g.alias("g")).collect()
    assert none is None and [round(p[0], 9) for p in arc["coords"][0][0]] == [0, 22.5, 45, 67.5, 90]


def test_joins_take_coordinates_as_they_stand(spark):
    """(-158.4, -64.6) is a rounding outside of the triangle's edge."""
    pts = spark.createDataFrame([(8568, -158.4, -64.6), (1, -180.0, -85.0), (2, -150.0, -85.0), (3, -144.0, -51.0), (4, -179.0, -51.0), (5, -144.0, -70.0)], "fid long, lng double, lat double")
    corners = ring((-180, -85), (-108, -85), (-144, -51), (-180, -85))
    hole = ring((-150, -75), (-138, -75), (-138, -65), (-150, -65), (-150, -75))
    polys = spark.createDataFrame([(0, ("Polygon", [[corners]])), (1, ("Polygon", [[corners[::-1]]])), (2, ("Polygon", [[corners, hole]]))], f"zid long, geom {GEOM_DDL}")
    for strategy in ("broadcast", "cells"):
        got = joins.point_polygon_pairs(pts, polys, strategy=strategy, mode="corrected").select("zid", "fid").collect()
        assert sorted(map(tuple, got)) == [(0, 1), (0, 2), (0, 3), (0, 5), (1, 1), (1, 2), (1, 3), (1, 5), (2, 1), (2, 2), (2, 3)]
        near = joins.point_polygon_pairs(pts, polys, strategy=strategy).filter("fid = 8568").count()
        assert near == 3  # the default keeps its tolerance
    assert joins.points_within(pts, polys, mode="corrected").filter("fid = 8568").count() == 0


def spots(*ids):
    """Vertices as the fixtures derive them from events' ids."""
    return [[float((e * 37) % 3600) / 10.0 - 180, float((e * 53) % 1700) / 10.0 - 85] for e in ids]


def test_ties_of_simplify_and_nearest_are_decided_as_in_sql(spark):
    """Of positions equally far but for a rounding, the one that SQL's arithmetic gives."""
    path = spots(688943, 692996, 693764, 693839)
    assert planar.simplify_path(path, 20.0) == [path[0], path[2], path[3]]
    df = spark.createDataFrame([(line(*spots(708267, 712966, 729737)),), (line((0, 0)),)], f"g {GEOM_DDL}")
    got = [r.n for r in df.select(L.nearest_point_on_line("g", G.point(100.0, 40.0)).alias("n")).collect()]
    assert got[0]["index"] == 1 and got[1] is None
    assert planar.nearest_on_path([5.0, 1.0], [[0.0, 0.0], [0.0, 0.0], [10.0, 0.0]])["index"] == 1


def test_split_where_a_line_comes_through_its_end(spark):
    """the second vertex may be the last or the first position once more."""
    lines = [line((0, 0), (1, 1), (2, 0), (1, 1)), line((1, 1), (1, 1), (2, 0)), line((0, 0), (1, 1)), line((0, 0), (1, 1), (2, 0))]
    df = spark.createDataFrame([(g,) for g in lines], f"g {GEOM_DDL}")
    parts = lambda **how: [[[list(map(tuple, x.coords[0][0])) for x in r.s]][0] for r in df.select(L.split("g", G.point(1.0, 1.0), **how).alias("s")).collect()]
    assert [len(p) for p in parts()] == [1, 1, 1, 2]
    got = parts(mode="corrected")
    assert [len(p) for p in got] == [2, 2, 1, 2]
    assert got[0] == [[(0, 0), (1, 1)], [(1, 1), (2, 0), (1, 1)]] and got[1] == [[(1, 1), (1, 1)], [(1, 1), (2, 0)]]


def test_interpolation_on_several_samples_takes_the_first(spark):
    """it took the least value."""
    rows = [(2, 0.0, 0.0, -5.0), (1, 0.0, 0.0, 7.0), (3, 4.0, 4.0, 1.0)]
    got = surfaces.interpolate(spark.createDataFrame(rows, "fid long, lng double, lat double, z double"), 4, "degrees")
    assert got.filter("x = 0 and y = 0").first().z == 7


def test_kmeans_goes_on_to_a_fixed_point(spark):
    """it stopped after 100 rounds."""
    assert inspect.signature(clusters.kmeans).parameters["max_iter"].default is None
    pts = spark.createDataFrame([(k, *p) for k, p in enumerate(spots(*range(300)))], "fid long, lng double, lat double")
    rows = clusters.kmeans(pts, 4).collect()
    for r in rows:
        own = [q for q in rows if q.cluster == r.cluster]
        assert (r.cx, r.cy) == pytest.approx((sum(q.lng for q in own) / len(own), sum(q.lat for q in own) / len(own)))
        assert min((r.lng - q.cx) ** 2 + (r.lat - q.cy) ** 2 for q in rows) == pytest.approx((r.lng - r.cx) ** 2 + (r.lat - r.cy) ** 2)
    cut = clusters.kmeans(pts, 4, max_iter=1).select("cx", "cy").distinct().collect()
    assert {(r.cx, r.cy) for r in rows} != {(r.cx, r.cy) for r in cut}
