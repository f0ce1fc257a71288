"""Clustering of points (fid, lng, lat), in the plane of degrees."""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.operators.graph import connected_components, cut_lineage
from meridia.plans.spatial_join import near_pairs


def kmeans(points: DataFrame, k: int, max_iter: int | None = None, seed: int = 0) -> DataFrame:
    """``points`` with cluster (0-based) and its centroid (cx, cy). Lloyd's iterations from
    seeded k-means++-like starts among the distinct points; k is cut to their number. Only
    the k centres are held on the driver; a round is one aggregate. Rounds go on until no
    centre moves, which they reach as the sum of squares falls, or for ``max_iter``."""
    if k < 1:
        raise ValueError("k must be positive")
    spots = points.select("lng", "lat").distinct()
    sample = [(r.lng, r.lat) for r in spots.orderBy(F.xxhash64("lng", "lat", F.lit(seed))).limit(max(20 * k, 200)).collect()]
    if not sample:
        raise ValueError("there are no points")
    rng, pool = np.random.default_rng(seed), np.array(sample)
    centres = pool[:1]
    while len(centres) < min(k, len(pool)):
        gap = ((pool[:, None, :] - centres[None]) ** 2).sum(2).min(1)
        if gap.sum() == 0:
            break
        centres = np.vstack([centres, pool[rng.choice(len(pool), p=gap / gap.sum())]])

    def assigned(df: DataFrame, c: np.ndarray) -> DataFrame:
        d = F.array(*(F.struct(((F.col("lng") - x) * (F.col("lng") - x) + (F.col("lat") - y) * (F.col("lat") - y)).alias("d"), F.lit(i).alias("i")) for i, (x, y) in enumerate(c.tolist())))
        return df.withColumn("cluster", F.array_min(d)["i"])

    # Places with their counts: fewer rows than points, read in every round.
    places = points.groupBy("lng", "lat").agg(F.count(F.lit(1)).alias("n")).persist()
    for _ in count() if max_iter is None else range(max_iter):
        sums = assigned(places, centres).groupBy("cluster").agg(F.sum(F.col("lng") * F.col("n")).alias("x"), F.sum(F.col("lat") * F.col("n")).alias("y"), F.sum("n").alias("n")).collect()
        means = {r.cluster: (r.x / r.n, r.y / r.n) for r in sums}
        after = np.array([means.get(i, tuple(centres[i])) for i in range(len(centres))])
        moved, centres = np.abs(after - centres).max(), after
        if moved < 1e-9:
            break
    places.unpersist()
    at = lambda j: F.element_at(F.array(*(F.lit(float(c[j])) for c in centres)), F.col("cluster") + 1)
    return assigned(points, centres).withColumn("cx", at(0)).withColumn("cy", at(1))


def dbscan(points: DataFrame, radius: float, min_points: int = 3) -> DataFrame:
    """``points`` with cluster: 0 for noise, otherwise numbered from 1 in order of each
    cluster's first core point.

    A core point has ``min_points`` others or more within the radius. Pairs come from an
    equi-join on grid cells of the radius; points at one place are one spot with a
    count, so a pile of equal points is no pile of pairs. Core points in reach of each other
    form a cluster; a border point joins its nearest core point's (then the smallest fid's).
    """
    if radius <= 0:
        raise ValueError("the radius must be positive")
    spots = cut_lineage(points.groupBy("lng", "lat").agg(F.min("fid").alias("sid"), F.count(F.lit(1)).alias("n")))
    left = spots.select(F.col("sid").alias("i"), F.col("lng").alias("x"), F.col("lat").alias("y"))
    right = spots.select(F.col("sid").alias("j"), F.col("lng").alias("rx"), F.col("lat").alias("ry"), F.col("n").alias("m"))
    pairs = cut_lineage(near_pairs(left, right, radius).select("i", "j", "m", "d"))
    core = cut_lineage(pairs.groupBy("i").agg((F.sum("m") - 1).alias("near")).filter(F.col("near") >= min_points).select("i"))
    to_core = pairs.join(core.select(F.col("i").alias("j")), "j", "left_semi")
    links = to_core.join(core, "i", "left_semi").select(F.col("i").alias("a"), F.col("j").alias("b"))
    parts = connected_components(links)
    home = core.join(parts, core["i"] == parts["node"], "left").select("i", F.coalesce("component", "i").alias("component"))
    border = to_core.join(core, "i", "left_anti").groupBy("i").agg(F.min(F.struct("d", "j")).alias("m")).select("i", F.col("m.j").alias("j"))
    border = border.join(home.withColumnRenamed("i", "j"), "j").select("i", "component")
    labels = home.unionByName(border)
    # Clusters are numbered by the count of smaller labels: at most one row for each cluster.
    from pyspark.sql import Window

    numbers = labels.select("component").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("component")))
    named = labels.join(numbers, "component").select(F.col("i").alias("sid"), "cluster")
    spot_of = spots.join(named, "sid", "left").select("lng", "lat", F.coalesce("cluster", F.lit(0)).alias("cluster"))
    return points.join(spot_of, ["lng", "lat"])


dbscan_within = dbscan


def dbscan_one_hop(points: DataFrame, radius: float, min_points: int = 3) -> DataFrame:
    """The variant in which a cluster is a core point, in order of fid, with those neighbours
    that no earlier cluster has; it isn't passed on from neighbour to neighbour. It depends
    on the order of all points, so it runs as one task and is for collections of a size
    that a single machine holds."""
    pts = points.select("fid", "lng", "lat").orderBy("fid").toPandas()
    xy = pts[["lng", "lat"]].to_numpy(float)
    label = np.full(len(xy), -1)
    n = 0
    for i in range(len(xy)):
        if label[i] != -1:
            continue
        near = np.flatnonzero(((xy - xy[i]) ** 2).sum(1) <= radius * radius)
        near = near[near != i]
        if len(near) < min_points:
            label[i] = 0
            continue
        n += 1
        label[i] = n
        label[near[(label[near] == -1) | (label[near] == 0)]] = n
    rows = points.sparkSession.createDataFrame(list(zip(pts["fid"].tolist(), label.tolist(), strict=True)), "fid long, cluster int")
    return points.join(rows, "fid")
