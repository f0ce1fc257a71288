"""Spatial statistics. Point tables have (fid, lng, lat) and value columns."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions import lines as L
from meridia.operators.graph import cut_lineage
from meridia.plans.spatial_join import near_pairs

BLOCK = 2048


def directional_mean(features: DataFrame, by=None) -> DataFrame:
    """Circular mean, in [0, 360), of the lines' directions from end to end; null without lines."""
    keys = [by] if isinstance(by, str) else list(by or [])
    parts = features.filter(G.get_type("geom").isin("LineString", "MultiLineString")).select(*keys, F.explode(F.transform(G.rings("geom"), G.linestring)).alias("g")).filter(F.size(G.path("g")) >= 2)
    turn = F.radians(L.direction(F.col("g")))
    mean = F.degrees(F.atan2(F.avg(F.sin(turn)), F.avg(F.cos(turn))))
    return parts.groupBy(*keys).agg(mean.alias("m")).select(*keys, F.when(F.col("m") < 0, F.col("m") + 360).otherwise(F.col("m")).alias("mean"))


def standard_deviational_ellipse(points: DataFrame, steps: int = 64) -> DataFrame:
    """One row: lng, lat, major and minor axis (two standard deviations), rotation in degrees
    from the x axis, and the ellipse's polygon; none for under three points. One pass."""
    m = points.agg(F.avg("lng").alias("lng"), F.avg("lat").alias("lat"), F.var_pop("lng").alias("vx"), F.var_pop("lat").alias("vy"), F.covar_pop("lng", "lat").alias("c"), F.count("lng").alias("n")).filter("n >= 3")
    t = F.lit(0.5) * F.atan2(2 * F.col("c"), F.col("vx") - F.col("vy"))
    cos, sin = F.cos("t"), F.sin("t")
    u = F.sqrt(F.greatest(F.lit(0.0), F.col("vx") * cos * cos + 2 * F.col("c") * sin * cos + F.col("vy") * sin * sin)) * 2
    v = F.sqrt(F.greatest(F.lit(0.0), F.col("vx") * sin * sin - 2 * F.col("c") * sin * cos + F.col("vy") * cos * cos)) * 2
    axes = m.withColumn("t", t).select("lng", "lat", u.alias("u"), v.alias("v"), "t")
    turn = lambda i: F.lit(2 * math.pi) * i / steps
    ring = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.array(F.col("lng") + F.col("u") * F.cos(turn(i)) * F.cos("t") - F.col("v") * F.sin(turn(i)) * F.sin("t"), F.col("lat") + F.col("u") * F.cos(turn(i)) * F.sin("t") + F.col("v") * F.sin(turn(i)) * F.cos("t")))
    return axes.select("lng", "lat", F.col("u").alias("axis_x"), F.col("v").alias("axis_y"), F.degrees("t").alias("rotation"), G.polygon(F.array(ring)).alias("geom"))


def nearest_neighbor_analysis(points: DataFrame) -> DataFrame:
    """One row: observed and expected mean distance (planar), ratio, z, one-sided p.

    Neighbours come from a search in growing grid cells; points at one place are counted
    as neighbours at distance 0 without pairing them.
    """
    spots = points.groupBy("lng", "lat").agg(F.count(F.lit(1)).alias("n"), F.min("fid").alias("fid"))
    lone = spots.select("fid", F.col("lng").alias("x"), F.col("lat").alias("y"), "n")
    others = lone.select(F.col("fid").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    box = points.agg(F.min("lng"), F.max("lng"), F.min("lat"), F.max("lat"), F.count(F.lit(1))).first()
    n = box[4]
    if n < 2:
        raise ValueError("at least 2 points are needed")
    gaps = _nearest_other(lone.select("fid", "x", "y"), others)
    total = lone.join(gaps, "fid", "left").agg(F.sum(F.when(F.col("n") == 1, F.col("d")).otherwise(0.0))).first()[0] or 0.0
    area = (box[1] - box[0]) * (box[3] - box[2])
    area = area if area > 0 else 1.0
    observed, expected = total / n, 0.5 * math.sqrt(area / n)
    se = 0.26136 / math.sqrt(n * n / area)
    z = (observed - expected) / se if se >= 1e-15 else 0.0
    row = (observed, expected, observed / expected, z, 0.5 * math.erfc(abs(z) / math.sqrt(2)))
    return points.sparkSession.createDataFrame([row], "observed double, expected double, ratio double, z double, p double")


def _nearest_other(left: DataFrame, right: DataFrame) -> DataFrame:
    """(fid, d): distance to the nearest other point, by growing cells."""
    box = right.agg(F.min("rx"), F.max("rx"), F.min("ry"), F.max("ry"), F.count(F.lit(1))).first()
    if box[4] < 2:
        return left.select("fid", F.lit(0.0).alias("d")).limit(0)
    size = math.sqrt(max((box[1] - box[0]) * (box[3] - box[2]), 1e-12) / box[4]) * 1.5
    parts, todo = [], left
    for _ in range(40):
        got = near_pairs(todo, right, size).filter("fid <> rid").groupBy("fid").agg(F.min("d").alias("d"))
        got = cut_lineage(got)
        parts.append(got)
        todo = todo.join(got.select("fid"), "fid", "left_anti")
        if todo.isEmpty():
            break
        size *= 4
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi_square_p(chi2: float, df: int, mode: str = "reference") -> float:
    """Probability that goes with a quadrat statistic: by default a customary figure (the
    series without its 1/a, and a rough tail beyond it), else the upper tail."""
    if chi2 <= 0 or df <= 0:
        return 1.0
    a, x = df / 2, chi2 / 2
    if mode == "corrected":
        return 1 - gamma_p(a, x)
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        return a * gamma_p(a, x)
    return 1 - scale / math.pi * (1 + 100 / x)


def quadrat_analysis(points: DataFrame, size: int = 10, mode: str = "reference") -> DataFrame:
    """One row: chi2, df, p of the counts in a size x size grid over the points' box."""
    size = size if size >= 2 else 10
    box = points.agg(F.min("lng"), F.max("lng"), F.min("lat"), F.max("lat"), F.count(F.lit(1))).first()
    if box[4] < 2:
        raise ValueError("at least 2 points are needed")
    w, h = (box[1] - box[0]) / size, (box[3] - box[2]) / size
    if w <= 0 or h <= 0:
        raise ValueError("the points are on one line")
    at = lambda c, lo, step: F.least(F.lit(size - 1), F.floor((F.col(c) - lo) / step).cast("int"))
    mean = box[4] / (size * size)
    # Empty cells add mean each; the others' sum is an aggregate of at most size² groups.
    cells = points.groupBy(at("lng", box[0], w).alias("c"), at("lat", box[2], h).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    s = cells.agg(F.sum((F.col("n") - mean) * (F.col("n") - mean) / mean).alias("s"), F.count(F.lit(1)).alias("k")).first()
    chi2, df = float(s.s + (size * size - s.k) * mean), size * size - 1
    return points.sparkSession.createDataFrame([(chi2, df, chi_square_p(chi2, df, mode))], "chi2 double, df int, p double")


def blocks(points: DataFrame, *values: str) -> DataFrame:
    """(block, fids, xs, ys, and an array per value): the points in packets of up to about ``BLOCK``."""
    n = max(1, -(-points.count() // BLOCK))
    rows = points.withColumn("block", F.pmod(F.xxhash64("fid"), F.lit(n)))
    packed = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("fid", "lng", "lat", *values))).alias("l"))
    return packed.select("block", F.col("l.fid").alias("fids"), F.col("l.lng").alias("xs"), F.col("l.lat").alias("ys"), *(F.col(f"l.{v}").alias(v) for v in values))


def _all_pairs(points: DataFrame, value: str) -> DataFrame:
    """Every pair of packets; for statistics that are about all pairs by definition."""
    a = blocks(points, value)
    b = a.select(*(F.col(c).alias(f"{c}_b") for c in a.columns))
    return a.crossJoin(b)


def moran_index(points: DataFrame, value: str, mode: str = "reference") -> DataFrame:
    """One row ``i``: the sum over pairs of w * d * d' over the sum of d², with w = 1/distance
    (1 at the same place); mode="corrected" scales by n over the sum of weights."""
    rows = points.filter(F.col(value).isNotNull()).select("fid", "lng", "lat", F.col(value).cast("double").alias("v"))
    stats = rows.agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"), F.count(F.lit(1)).alias("n")).first()
    if stats.n < 3:
        raise ValueError("at least 3 values are needed")
    mean = stats.m

    def sums(batches):
        for batch in batches:
            num, weights = 0.0, 0.0
            for r in batch.to_pylist():
                xy, uv = np.column_stack([r["xs"], r["ys"]]), np.column_stack([r["xs_b"], r["ys_b"]])
                d = np.hypot(xy[:, :1] - uv[:, 0], xy[:, 1:] - uv[:, 1])
                w = np.where(d > 1e-15, 1 / np.maximum(d, 1e-15), 1.0)
                w[np.asarray(r["fids"])[:, None] == np.asarray(r["fids_b"])] = 0
                num += float((w * np.outer(np.asarray(r["v"]) - mean, np.asarray(r["v_b"]) - mean)).sum())
                weights += float(w.sum())
            yield pa.record_batch({"num": pa.array([num]), "w": pa.array([weights])})

    got = _all_pairs(rows, "v").mapInArrow(sums, "num double, w double").agg(F.sum("num").alias("num"), F.sum("w").alias("w")).first()
    spread = (stats.s or 0.0) * stats.n
    i = 0.0 if spread < 1e-15 else got.num / spread
    if mode == "corrected" and got.w:
        i *= stats.n / got.w
    return points.sparkSession.createDataFrame([(float(i),)], "i double")


def distance_weight(points: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(i, j, w): inverse planar distances of pairs that aren't at one place, up to the
    threshold if there is one; what isn't listed is 0. With a threshold the pairs come
    from an equi-join on grid cells; without one they are all pairs, by definition."""
    left = points.select(F.col("fid").alias("i"), F.col("lng").alias("x"), F.col("lat").alias("y"))
    right = points.select(F.col("fid").alias("j"), F.col("lng").alias("rx"), F.col("lat").alias("ry"))
    pairs = near_pairs(left, right, threshold) if threshold > 0 else left.crossJoin(right).withColumn("d", F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry")))
    return pairs.filter((F.col("i") != F.col("j")) & (F.col("d") > 0)).select("i", "j", (1 / F.col("d")).alias("w"))


__all__ = ["chi_square_p", "directional_mean", "distance_weight", "moran_index", "nearest_neighbor_analysis", "quadrat_analysis", "standard_deviational_ellipse"]
