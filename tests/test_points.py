"""Geodesy on points: literal values, round trips, and units."""

import math

import pytest
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions import points as P
from meridia.schema import convert_length


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def pair(spark, columns):
    return tuple(spark.range(1).select(columns[0].alias("x"), columns[1].alias("y")).first())


def test_distance(spark):
    assert value(spark, P.distance(-75.343, 39.984, -75.534, 39.123)) == pytest.approx(97.129, abs=1e-3)
    assert value(spark, P.haversine(0, 0, 0, 0)) == 0
    assert value(spark, P.distance(0, 0, 180, 0, "radians")) == pytest.approx(math.pi)


def test_bearings(spark):
    assert value(spark, P.bearing(0, 0, 0, 10)) == pytest.approx(0)
    assert value(spark, P.bearing(0, 0, 10, 0)) == pytest.approx(90)
    assert value(spark, P.bearing(0, 0, -10, 0)) == pytest.approx(270)
    assert value(spark, P.rhumb_bearing(0, 0, 10, 0, "corrected")) == pytest.approx(90)
    assert value(spark, P.rhumb_bearing(170, 0, -170, 0, "corrected")) == pytest.approx(90)


def test_destination(spark):
    x, y = pair(spark, P.destination(0, 0, 111.32, 90))
    assert x == pytest.approx(1, abs=0.01) and y == pytest.approx(0, abs=1e-9)
    x, y = pair(spark, P.destination(10, 20, 500, 37))
    assert value(spark, P.distance(10, 20, x, y)) == pytest.approx(500)


def test_wrap_modes(spark):
    west = pair(spark, P.destination(-179.9, 0, 100, 270))
    assert west[0] < -180
    assert pair(spark, P.destination(-179.9, 0, 100, 270, mode="corrected"))[0] == pytest.approx(west[0] + 360)


def test_rhumb(spark):
    assert value(spark, P.rhumb_distance(0, 0, 10, 0)) == pytest.approx(value(spark, P.distance(0, 0, 10, 0)))
    x, y = pair(spark, P.rhumb_destination(5, 5, 100, 0))
    assert x == pytest.approx(5) and value(spark, P.distance(5, 5, x, y)) == pytest.approx(100)


def test_midpoint_and_angle(spark):
    x, y = pair(spark, P.midpoint(0, 0, 10, 0))
    assert (x, y) == (pytest.approx(5), pytest.approx(0))
    assert value(spark, P.angle(10, 0, 0, 0, 0, 10)) == pytest.approx(90)
    assert value(spark, P.angle(-10, 0, 0, 0, 10, 0)) == pytest.approx(180)


def test_mercator_round_trip(spark):
    assert pair(spark, P.wgs84(*P.mercator(12.5, -47.25))) == (pytest.approx(12.5), pytest.approx(-47.25))


def test_plane(spark):
    corners = ((0, 0, 0), (1, 0, 10), (0, 1, 20))
    assert value(spark, P.plane_z(0.25, 0.25, *corners)) == pytest.approx(7.5)
    assert value(spark, P.plane_z(0.5, 0.25, *corners, mode="corrected")) == pytest.approx(10)


def test_units():
    assert convert_length(1, "miles", "meters") == pytest.approx(1609.344)
    assert convert_length(1000, "meters", "kilometers") == 1
    assert convert_length(5, "cubits", "meters") == 5


def test_segments(spark):
    meets = lambda *v: value(spark, P.segments_meet(*v))
    assert meets(0, 0, 10, 10, 0, 10, 10, 0) and meets(0, 0, 5, 0, 5, 0, 10, 0)
    assert not meets(0, 0, 5, 0, 6, 0, 10, 0) and not meets(0, 0, 10, 0, 0, 1, 10, 1)


def test_nulls_stay_null(spark):
    row = spark.range(1).select(F.lit(None).cast("double").alias("x"))
    assert row.select(P.distance(F.col("x"), 0, 0, 0)).first()[0] is None
    assert row.select(G.x_of(G.point("x", 1.0))).first()[0] is None
