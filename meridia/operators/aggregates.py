"""Aggregates over collections of features; with ``by`` they are per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions import kernels as K
from meridia.functions.kernels import kernel
from meridia.kernels import planar
from meridia.schema import GEOM_DDL, LINE, MULTILINE, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def _boxed(df: DataFrame) -> DataFrame:
    return df.withColumn("_b", G.bbox("geom"))


def bbox(features: DataFrame, by=None) -> DataFrame:
    """minx, miny, maxx, maxy over all vertices; rows combine before the shuffle."""
    b = _boxed(features)
    return b.groupBy(*_by(by)).agg(F.min("_b.minx").alias("minx"), F.min("_b.miny").alias("miny"), F.max("_b.maxx").alias("maxx"), F.max("_b.maxy").alias("maxy"))


def center(features: DataFrame, by=None) -> DataFrame:
    return bbox(features, by).select(*_by(by), ((F.col("minx") + F.col("maxx")) / 2).alias("lng"), ((F.col("miny") + F.col("maxy")) / 2).alias("lat"))


def centroid(features: DataFrame, by=None) -> DataFrame:
    """Mean of all vertices of all features; null without any."""
    ps = G.positions("geom")
    sums = features.select(*_by(by), G.total(ps, lambda p: p[0]).alias("x"), G.total(ps, lambda p: p[1]).alias("y"), F.size(ps).alias("n"))
    return sums.groupBy(*_by(by)).agg(F.try_divide(F.sum("x"), F.sum("n")).alias("lng"), F.try_divide(F.sum("y"), F.sum("n")).alias("lat"))


def center_mean(points: DataFrame, weight: str | None = None, by=None) -> DataFrame:
    """Weighted mean of points (lng, lat); a null weight counts as 1; null for no weight at all."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    rows = points.select(*_by(by), (F.col("lng") * w).alias("x"), (F.col("lat") * w).alias("y"), w.alias("w"))
    total = F.nullif(F.sum("w"), F.lit(0.0))
    return rows.groupBy(*_by(by)).agg((F.sum("x") / total).alias("lng"), (F.sum("y") / total).alias("lat"))


def center_median(points: DataFrame, weight: str | None = None, by=None) -> DataFrame:
    """The first point in order of fid at which the running weight reaches half; (0, 0)
    without points. Without groups the running sum is taken over blocks of ids first, so
    that no task sees all rows in one window."""
    keys = _by(by)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    rows = points.select(*keys, "fid", "lng", "lat", w.alias("w"))
    if keys:
        order = Window.partitionBy(*keys).orderBy("fid")
        run = rows.withColumn("run", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("half", F.sum("w").over(Window.partitionBy(*keys)) / 2)
        return run.filter("run >= half").groupBy(*keys).agg(F.min_by(F.struct("lng", "lat"), "fid").alias("m")).select(*keys, "m.lng", "m.lat")
    span = rows.agg(F.min("fid").alias("lo"), F.max("fid").alias("hi"), F.sum("w").alias("w")).first()
    if span.lo is None:
        return points.sparkSession.createDataFrame([(0.0, 0.0)], "lng double, lat double")
    width = max(1, (span.hi - span.lo) // 4096 + 1)
    blocks = rows.withColumn("block", F.floor((F.col("fid") - span.lo) / F.lit(width)))
    sums = blocks.groupBy("block").agg(F.sum("w").alias("w")).withColumn("before", F.coalesce(F.sum("w").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    order = Window.partitionBy("block").orderBy("fid").rowsBetween(Window.unboundedPreceding, 0)
    run = blocks.withColumn("run", F.sum("w").over(order)).join(F.broadcast(sums.select("block", "before")), "block")  # 4,097 rows at most
    hit = run.filter(F.col("before") + F.col("run") >= span.w / 2)
    return hit.agg(F.min_by(F.struct("lng", "lat"), "fid").alias("m")).select(F.coalesce("m.lng", F.lit(0.0)).alias("lng"), F.coalesce("m.lat", F.lit(0.0)).alias("lat"))


def area(features: DataFrame, by=None, mode: str = "reference") -> DataFrame:
    return features.groupBy(*_by(by)).agg(F.sum(G.area("geom", mode)).alias("area"))


def counts(features: DataFrame, by=None) -> DataFrame:
    """coords, features, geoms (those that aren't null)."""
    return features.groupBy(*_by(by)).agg(F.coalesce(F.sum(F.when(F.col("geom").isNotNull(), G.coord_count("geom"))), F.lit(0)).alias("coords"), F.count(F.lit(1)).alias("features"), F.count("geom").alias("geoms"))


def first_coord(features: DataFrame) -> DataFrame:
    """(lng, lat): a collection's "first" coordinate is the last vertex of its first feature."""
    rows = features.filter(F.size(G.positions("geom")) > 0)
    return rows.agg(F.min_by(F.element_at(G.positions("geom"), -1), "fid").alias("p")).select(F.col("p")[0].alias("lng"), F.col("p")[1].alias("lat"))


def last_coord(features: DataFrame) -> DataFrame:
    rows = features.filter(F.size(G.positions("geom")) > 0)
    return rows.agg(F.max_by(F.element_at(G.positions("geom"), -1), "fid").alias("p")).select(F.col("p")[0].alias("lng"), F.col("p")[1].alias("lat"))


def coord_reduce(features: DataFrame, zero: Column, merge) -> DataFrame:
    """Folds each feature's vertices: ``merge(acc, position)`` from ``zero``; column ``acc`` beside fid."""
    return features.select("fid", F.aggregate(G.positions("geom"), zero, merge).alias("acc"))


def combine(features: DataFrame, by=None) -> DataFrame:
    """Points, lines and polygons of a group (and their multi kinds) into one multi-geometry
    each, in order of fid; other columns go."""
    kind = F.when(G.get_type("geom").isin(POINT, MULTIPOINT), MULTIPOINT).when(G.get_type("geom").isin(LINE, MULTILINE), MULTILINE).when(G.get_type("geom").isin(POLYGON, MULTIPOLYGON), MULTIPOLYGON)
    rows = features.select(*_by(by), "fid", kind.alias("type"), F.col("geom.coords").alias("coords")).filter("type is not null")
    lists = rows.groupBy(*_by(by), "type").agg(F.array_sort(F.collect_list(F.struct("fid", "coords"))).alias("l"))
    polys = F.flatten(F.col("l.coords"))
    coords = F.when(F.col("type") == MULTIPOLYGON, polys).when(F.col("type") == MULTILINE, F.array(F.flatten(polys))).otherwise(F.array(F.array(F.flatten(F.flatten(polys)))))
    return lists.select(*_by(by), G.geom(F.col("type"), coords).alias("geom"))


def dissolve(features: DataFrame, field: str) -> DataFrame:
    """Polygons of equal ``field`` that share a vertex, merged: (field, component, geom).

    Vertices (rounded to 10 decimals) link polygons within a key, components follow from
    the links, and each component is one union.
    """
    from meridia.operators.graph import connected_components

    rows = features.filter(G.is_areal("geom")).select("fid", F.col(field).cast("string").alias("key"), "geom")
    spots = rows.select("fid", "key", F.explode(F.array_distinct(F.transform(G.positions("geom"), lambda p: F.struct(F.round(p[0], 10).alias("x"), F.round(p[1], 10).alias("y"))))).alias("p"))
    lead = spots.groupBy("key", "p").agg(F.min("fid").alias("a"))
    links = spots.join(lead, (spots["key"].eqNullSafe(lead["key"])) & (spots["p"] == lead["p"])).select("a", F.col("fid").alias("b")).filter("a <> b").distinct()
    parts = connected_components(links)
    owned = rows.join(parts, rows["fid"] == parts["node"], "left").select("key", "fid", F.coalesce("component", "fid").alias("component"), "geom")
    merged = owned.groupBy("key", "component").agg(F.array_sort(F.collect_list(F.struct("fid", "geom"))).alias("l"))
    return merged.select(F.col("key").alias(field), "component", F.when(F.size("l") == 1, F.get("l", F.lit(0))["geom"]).otherwise(K.union_all(F.col("l.geom"))).alias("geom"))


def convex_hull(features: DataFrame, by=None) -> DataFrame:
    """Hull of all vertices (geom), per group; null for under three. It is decomposable:
    partial hulls per partition, then the hull of their vertices."""
    keys = _by(by)
    partial = features.select(*keys, F.explode(G.positions("geom")).alias("p"), F.spark_partition_id().alias("_s"))
    rim = lambda ps: kernel(lambda x: [q for poly in planar.convex_hull(x)["coords"] for r in poly for q in r] if x else [], "array<array<double>>", ps)
    few = partial.groupBy(*keys, "_s", (F.pmod(F.hash("p"), F.lit(64))).alias("_k")).agg(F.collect_set("p").alias("ps"), F.count(F.lit(1)).alias("n")).select(*keys, rim("ps").alias("ps"), "n")
    whole = few.groupBy(*keys).agg(F.flatten(F.collect_list("ps")).alias("ps"), F.sum("n").alias("n"))
    return whole.select(*keys, F.when(F.col("n") >= 3, kernel(planar.convex_hull, GEOM_DDL, "ps")).alias("geom"))
