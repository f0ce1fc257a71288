"""Index-like operators: box search, distance search, k nearest, and list maintenance.

The index of a table is its box columns: Parquet keeps their minima and maxima, so a
search over a table written by ``load`` skips the row groups that it can't need.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions import points as P
from meridia.operators.graph import cut_lineage

BOX = ("minx", "miny", "maxx", "maxy")


def with_box(features: DataFrame) -> DataFrame:
    """``features`` with top-level box columns of ``geom``."""
    return features.withColumn("_b", G.bbox("geom")).select(*features.columns, *(F.col(f"_b.{c}").alias(c) for c in BOX))


def load(features: DataFrame, path: str) -> None:
    """Writes the features as an index, clustered by place."""
    n = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    with_box(features).repartitionByRange(n, F.floor("minx"), F.floor("miny")).sortWithinPartitions("minx", "miny").write.mode("overwrite").parquet(path)


def insert(index: DataFrame, features: DataFrame) -> DataFrame:
    return index.unionByName(with_box(features))


def remove(index: DataFrame, fids: DataFrame) -> DataFrame:
    return index.join(fids.select("fid"), "fid", "left_anti")


def clear(index: DataFrame) -> DataFrame:
    return index.limit(0)


def all_entries(index: DataFrame) -> DataFrame:
    return index.drop(*BOX)


def search(index: DataFrame, box) -> DataFrame:
    """Features whose box meets a box, edges included; none for a box of under four numbers."""
    if len(box) < 4:
        return index.limit(0)
    x1, y1, x2, y2 = (float(v) for v in box[:4])
    return index.filter((F.col("minx") <= x2) & (F.col("maxx") >= x1) & (F.col("miny") <= y2) & (F.col("maxy") >= y1))


def collisions(index: DataFrame, x: float, y: float, distance: float) -> DataFrame:
    """Features whose box is within a planar distance of a point."""
    return index.filter(P.box_distance(x, y, *(F.col(c) for c in BOX)) <= distance)


def nearest(index: DataFrame, x: float, y: float, n: int) -> DataFrame:
    """The n features whose boxes are nearest to a point (planar), nearest first, then by fid."""
    return index.withColumn("dist", P.box_distance(x, y, *(F.col(c) for c in BOX))).orderBy("dist", "fid").limit(n)


def sphere_nearest(points: DataFrame, others: DataFrame, k: int = 1, rounds: int = 30) -> DataFrame:
    """The k great-circle nearest of ``others`` (sid, slng, slat) for each point (fid, lng, lat):
    (fid, sid, dist in metres, rank). Ties go to the smaller sid.

    Both are placed on the unit sphere. A round deals ``others`` to cubes of an edge and
    each point to its 27 cubes, keeps pairs within the edge, and settles the points with
    k of them; the others go on with an edge three times as long.
    """
    spark = points.sparkSession
    ball = lambda x, y: (F.cos(F.radians(F.col(y))) * F.cos(F.radians(F.col(x))), F.cos(F.radians(F.col(y))) * F.sin(F.radians(F.col(x))), F.sin(F.radians(F.col(y))))
    n = others.count()
    right = others.select("sid", "slng", "slat", *(c.alias(f"s{i}") for i, c in enumerate(ball("slng", "slat"))))
    left = points.select("fid", "lng", "lat", *(c.alias(f"p{i}") for i, c in enumerate(ball("lng", "lat"))))
    need = min(k, n)
    if not need:
        return points.select("fid", F.lit(None).cast("long").alias("sid"), F.lit(0.0).alias("dist"), F.lit(1).alias("rank")).limit(0)
    edge = min(2.0, max(1e-6, math.sqrt(4 * math.pi * need / n)))
    parts, todo = [], left
    for _ in range(rounds):
        cube = lambda p: [F.floor(F.col(f"{p}{i}") / F.lit(edge)).cast("int").alias(f"c{i}") for i in range(3)]  # noqa: E731, B023
        near = F.array(*(F.struct(*(F.lit(d).alias(f"d{i}") for i, d in enumerate((a, b, c)))) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)))
        spread = right.select("*", *cube("s")).withColumn("_d", F.explode(near)).select("sid", "slng", "slat", "s0", "s1", "s2", *((F.col(f"c{i}") + F.col(f"_d.d{i}")).alias(f"c{i}") for i in range(3)))
        gap = sum(((F.col(f"p{i}") - F.col(f"s{i}")) * (F.col(f"p{i}") - F.col(f"s{i}")) for i in range(3)), F.lit(0.0))
        pairs = todo.select("*", *cube("p")).join(spread, ["c0", "c1", "c2"]).filter(gap <= edge * edge)
        dist = P.haversine("lng", "lat", "slng", "slat")
        if need == 1:
            best = pairs.groupBy("fid").agg(F.min(F.struct(dist.alias("dist"), "sid")).alias("m")).select("fid", "m.sid", "m.dist", F.lit(1).alias("rank"))
        else:
            w = Window.partitionBy("fid").orderBy("dist", "sid")
            ranked = pairs.select("fid", "sid", dist.alias("dist")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= need)
            best = ranked.join(ranked.filter(F.col("rank") == need).select("fid"), "fid", "left_semi")
        best = cut_lineage(best)
        parts.append(best)
        todo = todo.join(best.select("fid").distinct(), "fid", "left_anti")
        if edge >= 2.0 or todo.isEmpty():
            break
        edge = min(2.0, edge * 3)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
