"""Joins of features with features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions import lines as L
from meridia.functions import points as P
from meridia.functions import predicates as Q
from meridia.plans.spatial_join import point_polygon_pairs
from meridia.schema import metres


def tag(points: DataFrame, polygons: DataFrame, field: str, out: str, strategy: str = "auto", mode: str = "reference") -> DataFrame:
    """``points`` (fid, lng, lat, ...) with the ``field`` of the first polygon (smallest zid)
    that holds each, null without one."""
    slim = polygons.select("zid", "geom", F.col(field).alias("_field"))
    found = point_polygon_pairs(points.select("fid", "lng", "lat"), slim, strategy=strategy, mode=mode)
    first = found.groupBy("fid").agg(F.min(F.struct("zid", "_field")).alias("_m")).select("fid", F.col("_m._field").alias(out))
    return points.join(first, "fid", "left")


def collect(polygons: DataFrame, points: DataFrame, field: str, out: str, strategy: str = "auto", mode: str = "reference") -> DataFrame:
    """``polygons`` (zid, geom, ...) with the array of ``field`` of the points in each, in
    order of fid; empty without any. Points whose field is null are skipped."""
    slim = points.select("fid", "lng", "lat", F.col(field).alias("_field")).filter("_field is not null")
    found = point_polygon_pairs(slim, polygons.select("zid", "geom"), strategy=strategy, mode=mode)
    kind = points.schema[field].dataType.simpleString()
    lists = found.groupBy("zid").agg(F.array_sort(F.collect_list(F.struct("fid", "_field"))).alias("_l")).select("zid", F.col("_l._field").alias(out))
    return polygons.join(lists, "zid", "left").withColumn(out, F.coalesce(out, F.array().cast(f"array<{kind}>")))


def points_within(points: DataFrame, polygons: DataFrame, strategy: str = "auto", mode: str = "reference") -> DataFrame:
    """The points that are in any of the polygons."""
    hits = point_polygon_pairs(points.select("fid", "lng", "lat"), polygons.select("geom"), strategy=strategy, mode=mode).select("fid")
    return points.join(hits, "fid", "left_semi")


def nearest_point(points: DataFrame, x: float, y: float) -> DataFrame:
    """The point nearest to a target by great circle, with its distance ``dist`` in
    kilometers; of equally near ones the smallest fid. One row, found without a sort."""
    return points.withColumn("dist", P.distance("lng", "lat", x, y)).orderBy("dist", "fid").limit(1)


def nearest_point_to_line(points: DataFrame, line: Column, unit: str = "kilometers") -> DataFrame:
    """The point nearest to a line, with its distance ``dist``."""
    return points.withColumn("dist", L.point_to_line(G.point("lng", "lat"), line, unit)).orderBy("dist", "fid").limit(1)


def nearest_each(points: DataFrame, others: DataFrame, unit: str = "kilometers") -> DataFrame:
    """For each point (fid, lng, lat) the great-circle nearest of ``others`` (sid, slng, slat):
    (fid, sid, dist). Others are points of the unit sphere here, dealt to cells of space,
    and searched in growing cubes, so neither poles nor the antimeridian are special."""
    from meridia.operators.index import sphere_nearest

    return sphere_nearest(points, others).withColumn("dist", F.col("dist") / metres(unit))


def line_intersections(left: DataFrame, right: DataFrame, cell: float = 1.0) -> DataFrame:
    """Distinct (x, y) where lines of ``left`` (geom) cross lines of ``right``: segments are
    dealt to grid cells, met there, and the crossing kept once."""
    return _segment_pairs(left, right, cell).select(F.explode(F.array(_crossing())).alias("p")).filter("p is not null").select(F.round(F.col("p")[0], 10).alias("x"), F.round(F.col("p")[1], 10).alias("y")).distinct()


def _segments(df: DataFrame, name: str, cell: float) -> DataFrame:
    seg = df.select(F.explode(L.segments("geom")).alias(name))
    at = lambda v: F.floor(v / F.lit(cell)).cast("long")
    lo = lambda k: F.least(F.col(f"{name}.a")[k], F.col(f"{name}.b")[k])
    hi = lambda k: F.greatest(F.col(f"{name}.a")[k], F.col(f"{name}.b")[k])
    first, last = F.col(f"{name}.a"), F.col(f"{name}.b")
    slope = F.try_divide(last[1] - first[1], last[0] - first[0])

    def column(x: Column) -> Column:
        """The cells of a column that the segment goes through, and no others of its box."""
        edge = lambda k: F.greatest(lo(1), F.least(hi(1), first[1] + (F.greatest(lo(0), F.least(hi(0), (x + k) * F.lit(cell))) - first[0]) * slope))
        flat = lambda y, whole: F.when(slope.isNull(), whole).otherwise(y)
        low, high = flat(F.least(edge(0), edge(1)) - 1e-9, lo(1)), flat(F.greatest(edge(0), edge(1)) + 1e-9, hi(1))
        return F.transform(F.sequence(at(F.greatest(low, lo(1))), at(F.least(high, hi(1)))), lambda y: F.struct(x.alias("cx"), y.alias("cy")))

    cells = F.flatten(F.transform(F.sequence(at(lo(0)), at(hi(0))), column))
    return seg.withColumn("cell", F.explode(cells))


def _segment_pairs(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    return _segments(left, "e", cell).join(_segments(right, "f", cell), "cell").select("e", "f").distinct()


def _crossing() -> Column:
    return L._crossing(F.col("e"), F.col("f"))


def intersecting_pairs(left: DataFrame, right: DataFrame, predicate=Q.intersects, cell: float = 1.0) -> DataFrame:
    """Pairs of geometries (lid, geom) and (rid, geom2) whose boxes meet and for which a
    predicate holds. Boxes are dealt to cells at levels of their own size; a pair counts in
    the one cell that holds the corner of what its boxes share, so it is met once."""
    from meridia.plans.spatial_join import TOUCH, _cells, _level

    def dealt(df: DataFrame, g: str, names: tuple[str, ...]) -> DataFrame:
        b = df.withColumn("_b", G.bbox(g))
        level = _level(F.col("_b.maxx") - F.col("_b.minx"), F.col("_b.maxy") - F.col("_b.miny"), cell)
        return b.withColumn("_level", level).select(*names, "_b", "_level")

    a, b = dealt(left, "geom", ("lid", "geom")), dealt(right, "geom2", ("rid", "geom2"))
    levels = sorted({r._level for r in a.select("_level").union(b.select("_level")).distinct().collect()} - {None})
    # Each pair meets at the coarser of its two levels: a box is dealt there from its own level up.
    def spread(df: DataFrame, box: str, level: str) -> DataFrame:
        up = F.filter(F.array(*(F.lit(k) for k in levels)), lambda k: k >= F.col("_level"))
        rows = df.withColumn("_at", F.explode(up))
        touched = [F.col("_b.minx") - TOUCH, F.col("_b.miny") - TOUCH, F.col("_b.maxx") + TOUCH, F.col("_b.maxy") + TOUCH]
        return rows.withColumn("_cell", F.explode(_cells(*touched, F.col("_at"), cell))).drop("_at").withColumnRenamed("_b", box).withColumnRenamed("_level", level)

    met = spread(a, "_ba", "_la").join(spread(b, "_bb", "_lb"), "_cell").filter(F.col("_cell.level") == F.greatest("_la", "_lb"))
    step = F.lit(cell) * F.pow(F.lit(2.0), F.col("_cell.level"))
    for axis, c in (("x", "cx"), ("y", "cy")):
        corner = F.greatest(F.col(f"_ba.min{axis}"), F.col(f"_bb.min{axis}"))
        met = met.filter((F.floor((corner - TOUCH) / step) == F.col(f"_cell.{c}")) & (corner - TOUCH <= F.least(F.col(f"_ba.max{axis}"), F.col(f"_bb.max{axis}")) + TOUCH))
    return met.filter(predicate("geom", "geom2")).select("lid", "rid")
