"""Surfaces from scattered points (fid, lng, lat, z): triangulation, Voronoi cells, inverse
distance weighting and contours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions.kernels import GEOMS_DDL, kernel
from meridia.kernels import planar as K
from meridia.operators.generators import _side, _steps, lattice
from meridia.operators.stats import blocks
from meridia.schema import GEOM_DDL

#: A triangulation is one task's work; beyond this many distinct points it asks for groups.
MAX_TIN = 200_000
SEEDS = 200_000


def tin(points: DataFrame, z: str | None = None, by: str | None = None) -> DataFrame:
    """Delaunay triangles (geom, a, b, c: heights of the corners), for each group of ``by``.
    A triangulation is global, so one group is one task's; groups run side by side."""
    key = F.col(by) if by else F.lit(0)
    rows = points.select(key.alias("g"), F.struct("fid", F.array(F.col("lng"), F.col("lat"), (F.col(z) if z else F.lit(None)).cast("double")).alias("p")).alias("s"))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    if (top := sizes.agg(F.max("n")).first()[0] or 0) > MAX_TIN:
        raise ValueError(f"a group of {top} points is too large to triangulate in one task; give groups with `by`")
    if top < 3 and not by:
        raise ValueError("at least 3 points are needed")
    lists = rows.groupBy("g").agg(F.array_sort(F.collect_list("s")).alias("l"))
    parts = lists.select("g", F.explode(kernel(K.tin, "array<struct<ring:array<array<double>>,a:double,b:double,c:double>>", F.col("l.p"))).alias("t"))
    out = parts.select("g", G.polygon(F.array("t.ring")).alias("geom"), "t.a", "t.b", "t.c")
    return out.withColumnRenamed("g", by) if by else out.drop("g")


def concave_hull(points: DataFrame, max_edge: float = math.inf) -> DataFrame:
    """One row (geom): the largest loop around the triangles with no edge beyond ``max_edge`` degrees."""
    tops = points.agg(F.countDistinct("lng", "lat").alias("n")).first().n
    if tops < 3:
        raise ValueError("at least 3 points are needed")
    if tops > MAX_TIN:
        raise ValueError(f"{tops} points are too many to triangulate in one task")
    every = points.agg(F.array_sort(F.collect_set(F.array("lng", "lat"))).alias("ps"))
    return every.select(kernel(lambda ps: K.concave_hull(ps, max_edge), GEOM_DDL, "ps").alias("geom"))


def voronoi(points: DataFrame, box) -> DataFrame:
    """(fid, geom): the part of the box nearest to each point. Cells are independent of each
    other: every task cuts its own, from the seeds around, which are sent to all tasks
    (no more than ``SEEDS``)."""
    box = [float(v) for v in box]
    if len(box) < 4:
        raise ValueError("a box has four numbers")
    rows = points.select("lng", "lat").distinct().limit(SEEDS + 1).collect()
    if len(rows) > SEEDS:
        raise ValueError(f"more than {SEEDS} distinct points; cut the box into parts")
    seeds = np.array(sorted((r.lng, r.lat) for r in rows), float).reshape(-1, 2)
    ring = kernel(lambda x, y: K.voronoi_cell(x, y, seeds, box), "array<array<double>>", "lng", "lat")
    return points.select("fid", ring.alias("r")).filter("r is not null").select("fid", G.polygon(F.array("r")).alias("geom"))


def _idw(lattice_xy: DataFrame, samples: DataFrame, power: float) -> DataFrame:
    """(fid, x, y, z): weighted means over all samples. Packets of samples meet packets of
    lattice points, and only sums of weights are shuffled. On a sample, its value; of several
    there, that of the smallest fid."""
    packs = blocks(samples.select("fid", "lng", "lat", F.col("z").cast("double").alias("z")), "z").select("fids", "xs", "ys", "z")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                px, py, sx, sy, v = (np.asarray(r[k], float) for k in ("px", "py", "xs", "ys", "z"))
                d = np.hypot(px[:, None] - sx, py[:, None] - sy)
                hit = d < 1e-15
                w = np.where(hit, 0.0, np.maximum(d, 1e-15) ** -power)
                first = [k if found else None for k, found in zip(hit.argmax(1).tolist(), hit.any(1).tolist(), strict=True)]
                out += zip(r["ids"], w.sum(1).tolist(), (w @ v).tolist(), *([None if k is None else c[k] for k in first] for c in (v.tolist(), r["fids"])), strict=True)
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=["fid", "w", "wv", "exact", "of"])

    cells = lattice_xy.groupBy(F.floor(F.col("fid") / 1024).alias("_p")).agg(F.collect_list(F.struct("fid", "x", "y")).alias("l")).select(F.col("l.fid").alias("ids"), F.col("l.x").alias("px"), F.col("l.y").alias("py"))
    parts = cells.crossJoin(packs).mapInArrow(sums, "fid long, w double, wv double, exact double, of long")
    total = parts.groupBy("fid").agg(F.sum("w").alias("w"), F.sum("wv").alias("wv"), F.min_by("exact", "of").alias("exact"))
    z = F.coalesce("exact", F.when(F.col("w") < 1e-15, F.lit(0.0)).otherwise(F.try_divide("wv", "w")))
    return lattice_xy.join(total.select("fid", z.alias("z")), "fid")


def _span(points: DataFrame) -> tuple:
    r = points.agg(F.min("lng"), F.min("lat"), F.max("lng"), F.max("lat"), F.count(F.lit(1))).first()
    return tuple(r)


def interpolate(points: DataFrame, side: float, unit: str = "kilometers", z: str = "z", power: float = 2.0) -> DataFrame:
    """(fid, x, y, z) on a lattice over the points' box, by inverse distance weighting."""
    rows = points.select("fid", "lng", "lat", F.col(z).cast("double").alias("z"))
    x1, y1, x2, y2, _ = _span(rows)
    data = rows.filter("z is not null")
    if data.limit(2).count() < 2:
        raise ValueError("at least 2 points with a value are needed")
    if side <= 0:
        raise ValueError("the side must be positive")
    s = _side(side, unit, y1, y2, 0.01)
    cells = lattice(points.sparkSession, _steps(x1, x2, s, True), _steps(y1, y2, s, True))
    return _idw(cells.select("fid", (x1 + F.col("i") * s).alias("x"), (y1 + F.col("j") * s).alias("y")), data, power)


def _cells(points: DataFrame, z: str) -> DataFrame:
    """(corners, z) of the contour grid's cells, every corner's height computed once."""
    data = points.select("fid", "lng", "lat", F.col(z).cast("double").alias("z")).filter("z is not null")
    x1, y1, x2, y2, n = _span(data)
    if n < 3:
        raise ValueError("at least 3 points with a value are needed")
    dx, dy = x2 - x1, y2 - y1
    size = math.sqrt(dx * dy / n) or max(dx, dy) / 20 or 0.01
    nx, ny = max(2, math.ceil(dx / size)), max(2, math.ceil(dy / size))
    grid = lattice(points.sparkSession, nx + 1, ny + 1).select("fid", "i", "j", (x1 + F.col("i") * size).alias("x"), (y1 + F.col("j") * size).alias("y"))
    corner = _idw(grid, data, 2.0).select("i", "j", F.struct("x", "y", "z").alias("v"))
    # A corner goes to the four cells around it, in the order in which the cell names it.
    spread = corner.select("v", F.explode(F.array(*(F.struct((F.col("i") - a).alias("ci"), (F.col("j") - b).alias("cj"), F.lit(k).alias("k")) for k, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))))).alias("c"))
    inside = spread.filter((F.col("c.ci") >= 0) & (F.col("c.cj") >= 0) & (F.col("c.ci") < nx) & (F.col("c.cj") < ny))
    cells = inside.groupBy("c.ci", "c.cj").agg(F.array_sort(F.collect_list(F.struct("c.k", "v"))).alias("l"))
    return cells.select("ci", "cj", F.transform("l", lambda e: F.array(e["v"]["x"], e["v"]["y"])).alias("corners"), F.transform("l", lambda e: e["v"]["z"]).alias("z"))


def isolines(points: DataFrame, breaks: list[float], z: str = "z") -> DataFrame:
    """(break, geom): contour lines. Segments are found cell by cell; a break's are joined
    into lines in one task each, which holds no more than that contour."""
    if not breaks:
        raise ValueError("at least 1 break is needed")
    cells = _cells(points, z)
    levels = cells.select("corners", "z", F.explode(F.array(*(F.lit(float(b)) for b in sorted(breaks)))).alias("break"))
    segments = levels.select("break", F.explode(kernel(K.contour_segments, "array<array<array<double>>>", "corners", "z", "break")).alias("s"))
    lists = segments.groupBy("break").agg(F.array_sort(F.collect_list("s")).alias("l"))
    return lists.select("break", F.explode(kernel(K.stitched, "array<array<array<double>>>", "l")).alias("p")).select("break", G.linestring("p").alias("geom"))


def isobands(points: DataFrame, breaks: list[float], z: str = "z") -> DataFrame:
    """(break, geom): polygons where the surface is from one break (which names the band) up to
    the next. Bands are cut from the cells side by side and merged in tiles, tile edges last."""
    if len(breaks) < 2:
        raise ValueError("at least 2 breaks are needed")
    cells = _cells(points, z)
    order = sorted(float(b) for b in breaks)
    bands = F.array(*(F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in zip(order[:-1], order[1:], strict=True)))
    reach = cells.withColumn("b", F.explode(bands)).filter((F.array_max("z") >= F.col("b.lo")) & (F.array_min("z") < F.col("b.hi")))
    tiles = reach.groupBy("b.lo", "b.hi", F.floor(F.col("ci") / 16).alias("ti"), F.floor(F.col("cj") / 16).alias("tj")).agg(F.array_sort(F.collect_list(F.struct("ci", "cj", "corners", "z"))).alias("l"))
    parts = tiles.select("lo", kernel(K.band_polygons, GEOMS_DDL, "l.corners", "l.z", "lo", "hi").alias("gs"))
    merged = parts.groupBy("lo").agg(F.flatten(F.collect_list("gs")).alias("gs"))
    from meridia.kernels.overlay import union_all

    whole = merged.select(F.col("lo").alias("break"), kernel(lambda gs: union_all(gs) if gs else None, GEOM_DDL, "gs").alias("g")).filter("g is not null")
    return whole.select("break", F.explode("g.coords").alias("p")).select("break", G.polygon("p").alias("geom"))


def polygonize(features: DataFrame) -> DataFrame:
    """(component, geom): the faces of the network that the features' segments form. Networks
    that don't touch are separate components, and each is one task's."""
    from meridia.functions import lines as L
    from meridia.operators.graph import connected_components

    key = lambda p: F.struct(F.round(p[0], 10).alias("x"), F.round(p[1], 10).alias("y"))
    seg = features.select(F.explode(L.segments("geom")).alias("s")).select(F.array_sort(F.array(key(F.col("s.a")), key(F.col("s.b")))).alias("s")).filter(F.col("s")[0] != F.col("s")[1]).distinct()
    ided = seg.select("s", F.xxhash64("s").alias("id"))
    ends = ided.select("id", F.explode("s").alias("v"))
    lead = ends.groupBy("v").agg(F.min("id").alias("a"))
    parts = connected_components(ends.join(lead, "v").select("a", F.col("id").alias("b")).filter("a <> b").distinct())
    owned = ided.join(parts, ided["id"] == parts["node"], "left").select("s", F.coalesce("component", "id").alias("component"))
    lists = owned.groupBy("component").agg(F.array_sort(F.collect_list(F.transform("s", lambda p: F.array(p["x"], p["y"])))).alias("l"))
    return lists.select("component", F.explode(kernel(lambda l: K.polygonize([tuple(s) for s in l]), GEOMS_DDL, "l")).alias("geom"))  # noqa: E741
