"""SQL functions, folds, streams and the entry module."""

import math
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from meridia import catalog
from meridia.functions import geometry as G
from meridia.functions import points as P
from meridia.functions import sql
from meridia.operators import meta
from meridia.schema import GEOM_DDL
from meridia.streaming import geofence


def test_sql_functions_agree(spark):
    sql.register(spark)
    row = spark.sql("SELECT geo_haversine(-75.343, 39.984, -75.534, 39.123) AS d, geo_bearing(0, 0, 10, 0) AS b, geo_destination_lng(10, 20, 500000, 37) AS x, geo_destination_lat(10, 20, 500000, 37) AS y, geo_mercator_y(45) AS m, geo_box_distance(0, 0, 3, 4, 9, 9) AS k").first()
    x, y = P.destination(10, 20, 500, 37)
    want = spark.range(1).select(P.haversine(-75.343, 39.984, -75.534, 39.123), F.lit(90.0), x, y, P.mercator(0, 45)[1], F.lit(5.0)).first()
    assert tuple(row) == pytest.approx(tuple(want))


def test_sql_reaches_lengths_boxes_and_kernels(spark):
    sql.register(spark)
    box = lambda x0, y0, x1, y1: f"named_struct('type', 'Polygon', 'coords', array(array(array(array({x0}D, {y0}D), array({x1}D, {y0}D), array({x1}D, {y1}D), array({x0}D, {y1}D), array({x0}D, {y0}D)))))"
    row = spark.sql(f"SELECT geo_length(a) AS len, geo_min_x(geo_union(a, b)) AS lo, geo_max_y(geo_union(a, b)) AS hi, geo_max_x(geo_intersection(a, b)) AS mid, geo_min_x(geo_buffer(a, 50D)) AS out, size(geo_simplify(a, 0.1D).coords) AS n, geo_max_x(geo_clip(a, 0D, 0D, 1D, 1D)) AS c FROM (SELECT {box(0, 0, 2, 2)} AS a, {box(1, 1, 3, 3)} AS b)").first()
    want = spark.range(1).select(G.length(G.box_polygon(0.0, 0.0, 2.0, 2.0), "meters", "corrected")).first()[0]
    assert row.len == pytest.approx(want) and (row.lo, row.hi, row.mid, row.n, row.c) == (0.0, 3.0, 2.0, 1, 1.0) and -0.6 < row.out < -0.4


def features(spark):
    shapes = [("Point", [[[[0.0, 0.0]]]]), ("LineString", [[[[0.0, 0.0], [2.0, 2.0]]]]), None]
    return spark.createDataFrame(list(enumerate(shapes)), f"fid long, geom {GEOM_DDL}")


def test_folds(spark):
    fs = features(spark)
    assert meta.coord_each(meta.geom_each(fs)).count() == 3
    assert meta.geom_reduce(fs, G.coord_count("geom")).first().acc == 3 and meta.feature_reduce(fs, F.lit(1)).first().acc == 3
    assert meta.flatten_reduce(meta.geom_each(fs), F.lit(1)).first().acc == 2
    assert tuple(meta.counts(fs).first()) == (3, 3, 2)
    with pytest.raises(Exception, match="expected Point"):
        meta.collection_of(fs, "Point").collect()


ZONES = [(1, ("Polygon", [[[[0.0, 0.0], [5.0, 0.0], [5.0, 5.0], [0.0, 5.0], [0.0, 0.0]]]])), (2, ("Polygon", [[[[10.0, 0.0], [15.0, 0.0], [15.0, 5.0], [10.0, 5.0], [10.0, 0.0]]]]))]


def test_streams(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00", 1.0, 1.0), (2, 1, "2024-01-01 00:10:00", 12.0, 1.0), (3, 1, "2024-01-01 00:20:00", 50.0, 1.0), (4, 2, "2024-01-01 00:05:00", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, lng double, lat double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    zones = spark.createDataFrame(ZONES, f"zid long, geom {GEOM_DDL}")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def drained(out, name, mode):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert sorted((r.event_id, r.zid) for r in drained(geofence.tag_stream(stream, zones), "tagged", "append")) == [(1, 1), (2, 2), (4, 1)]
    assert {r.zid: r.n for r in drained(geofence.zone_counts(stream, zones), "counted", "complete")} == {1: 2, 2: 1}
    assert sorted((r.event_id, r.zid) for r in drained(geofence.point_polygon_pairs(stream, zones, strategy="cells"), "celled", "append")) == [(1, 1), (2, 2), (4, 1)]
    apart = sorted((r.user_id, r.ts.minute, r.zid, r.move) for r in drained(geofence.enter_leave(stream, zones, "cells"), "apart", "append"))
    moves = sorted((r.user_id, r.ts.minute, r.zid, r.move) for r in drained(geofence.enter_leave(stream, zones), "moves", "append"))
    assert apart == moves == [(1, 0, 1, "enter"), (1, 10, 1, "leave"), (1, 10, 2, "enter"), (1, 20, 2, "leave"), (2, 5, 1, "enter")]


def test_entry(spark):
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["fid", "zone"]


@pytest.mark.parametrize("name", ["distance", "tag_points", "nearest_each", "area_holes", "center_median", "polygon_xor", "geojson_roundtrip"])
def test_queries_match_duckdb(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "supplier", "nation", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    rows = sorted(str([round(v, 5) if isinstance(v, float) else v for v in (r[c] for c in cols)]) for r in got.collect())
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLES[name]}) q").fetchall()
    assert rows == sorted(str([round(v, 5) if isinstance(v, float) else v for v in r]) for r in want)


@pytest.fixture(scope="module")
def wide_dir(spark, sf_dir, tmp_path_factory):
    """Few rows, with keys from all over their range."""
    d = str(tmp_path_factory.mktemp("wide"))
    shutil.copy(f"{sf_dir}/nation.parquet", d)
    spark.createDataFrame([(k, 1, 1.0) for k in (0, 7, 9, 11, 50, 101, 110, 189, 260)], "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(k, 1, 1.0) for k in (1, 45, 90, 133, 163, 270, 450, 641, 990, 1603, 1605)], "c_custkey long, c_nationkey long, c_acctbal double").write.parquet(f"{d}/customer.parquet")
    return d


def boxes_of(spark, d):
    sides = catalog.X.boxes(spark, d).select("sid", "bx0", "by0", "bx1", "by1").collect()
    return {r.sid: (r.bx0, r.by0, r.bx1, r.by1) for r in sides}


@pytest.mark.parametrize("op", ["union", "intersect", "difference", "xor"])
def test_overlays_of_all_pairs(spark, wide_dir, op):
    boxes = boxes_of(spark, wide_dir)
    want = {}
    for z in catalog.X.zones(spark, wide_dir).collect():
        for sid, (x0, y0, x1, y1) in boxes.items():
            a, b = (z.x1 - z.x0) * (z.y1 - z.y0), (x1 - x0) * (y1 - y0)
            both = max(0, min(z.x1, x1) - max(z.x0, x0)) * max(0, min(z.y1, y1) - max(z.y0, y0))
            want[z.zid, sid] = {"union": a + b - both, "intersect": both, "difference": a - both, "xor": a + b - 2 * both}[op]
    got = {(r.zid, r.sid): r.a for r in catalog.QUERIES[f"polygon_{op}"](spark, wide_dir).collect()}
    assert len(got) == 225 and got == pytest.approx(want, abs=1e-5)


def test_buffers_of_all_boxes(spark, wide_dir):
    got = {r.sid: r.lower for r in catalog.QUERIES["buffer"](spark, wide_dir).collect()}
    assert got == pytest.approx({k: (x1 - x0) * (y1 - y0) for k, (x0, y0, x1, y1) in boxes_of(spark, wide_dir).items()}, abs=1e-5)


def test_crossings_of_all_lines(spark, wide_dir):
    at = [(r.slng, r.slat) for r in catalog.X.suppliers(spark, wide_dir).collect()]
    want = {(round(x, 10), round(y, 10)) for x, b in at for a, y in at if abs(a - x) <= 20 and abs(y - b) <= 20}
    assert catalog.QUERIES["line_intersections"](spark, wide_dir).first().n == len(want) > 9


def test_rhumb_destinations_of_all_points(spark, wide_dir):
    turn = lambda v: math.degrees(math.fmod(v + math.pi, 2 * math.pi) - math.pi)
    step, want, skipped = 500_000 / catalog.R, {}, 0
    for r in catalog.X.customers(spark, wide_dir).collect():
        lat, b = math.radians(r.lat), math.radians(r.fid % 360)
        skipped += abs(r.lat) >= 80 or r.fid % 180 == 90
        lat2 = lat + step * math.cos(b)
        q = math.cos(lat) if r.fid % 180 == 90 else (lat2 - lat) / math.log(math.tan(lat2 / 2 + math.pi / 4) / math.tan(lat / 2 + math.pi / 4))
        want[r.fid] = (turn(math.radians(r.lng) + step * math.sin(b) / q), math.degrees(lat2))
    got = {r.fid: (r.x, r.y) for r in catalog.QUERIES["rhumb_destination"](spark, wide_dir).collect()}
    assert skipped >= 5 and set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
