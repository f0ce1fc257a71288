"""Geometry derived from the integer keys of the test tables, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import geometry as G

_LNG = "cast(({k}*{a})%3600 as double)/cast(10 as double)-180"
_LAT = "cast(({k}*{a})%1700 as double)/cast(10 as double)-85"

P_SQL = f"select c_custkey as fid, {_LNG.format(k='c_custkey', a=37)} as lng, {_LAT.format(k='c_custkey', a=53)} as lat, {_LNG.format(k='c_custkey', a=411)} as lng2, {_LAT.format(k='c_custkey', a=173)} as lat2, c_acctbal as w, c_nationkey as g from customer"
S_SQL = f"select s_suppkey as sid, {_LNG.format(k='s_suppkey', a=411)} as slng, {_LAT.format(k='s_suppkey', a=173)} as slat, s_acctbal as v, s_nationkey as sg from supplier"
Z_SQL = "select cast(n_nationkey as bigint) as zid, n_name as name, cast(-180 as double)+72*(n_nationkey%5) as x0, cast(-85 as double)+34*floor(n_nationkey/5) as y0, cast(-180 as double)+72*(n_nationkey%5)+72 as x1, cast(-85 as double)+34*floor(n_nationkey/5)+34 as y1 from nation"
T_SQL = f"select event_id, user_id, ts, {_LNG.format(k='event_id', a=37)} as lng, {_LAT.format(k='event_id', a=53)} as lat from events"
#: Boxes about the suppliers, of 2 to 41 degrees.
B_SQL = "select sid, slng - (1 + sid % 20) as bx0, slat - (1 + sid % 20) as by0, slng + (1 + sid % 20) as bx1, slat + (1 + sid % 20) as by1 from (" + S_SQL + ")"


def _sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    for t in tables:
        text = text.replace(f" from {t}", f" from parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(text)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points fid, lng, lat, a second point lng2, lat2, a weight w and a group g."""
    return _sql(spark, sf_dir, P_SQL, "customer")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, S_SQL, "supplier")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles that tile the world, zid, name, x0, y0, x1, y1, geom."""
    return _sql(spark, sf_dir, Z_SQL, "nation").withColumn("geom", G.box_polygon("x0", "y0", "x1", "y1"))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle in every zone: its lower corners and the middle of its upper edge."""
    z = zones(spark, sf_dir)
    ring = F.array(G.position("x0", "y0"), G.position("x1", "y0"), G.position((F.col("x0") + F.col("x1")) / 2, "y1"), G.position("x0", "y0"))
    return z.withColumn("geom", G.polygon(F.array(ring)))


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every zone with a hole of half its size in the middle, wound like the exterior (rev=0) and against it (rev=1)."""
    z = zones(spark, sf_dir)
    w, h = (F.col("x1") - F.col("x0")) / 4, (F.col("y1") - F.col("y0")) / 4
    hole = F.col("inner.coords")[0][0]
    inner = z.withColumn("inner", G.box_polygon(F.col("x0") + w, F.col("y0") + h, F.col("x1") - w, F.col("y1") - h))
    rows = inner.select("zid", "x0", "y0", "x1", "y1", F.explode(F.array(F.lit(0), F.lit(1))).alias("rev"), G.path("geom").alias("shell"), hole.alias("hole"))
    return rows.withColumn("geom", G.polygon(F.array("shell", F.when(F.col("rev") == 0, F.col("hole")).otherwise(F.reverse("hole")))))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, T_SQL, "events")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for every user of two events or more, in order of time: fid, geom."""
    rows = vertices(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "lng", "lat"))).alias("l")).filter(F.size("l") >= 2)
    return rows.select(F.col("user_id").alias("fid"), G.linestring(F.transform("l", lambda p: F.array(p["lng"], p["lat"]))).alias("geom"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes about the suppliers: sid, bx0, by0, bx1, by1, geom2."""
    return _sql(spark, sf_dir, B_SQL, "supplier").withColumn("geom2", G.box_polygon("bx0", "by0", "bx1", "by1"))
