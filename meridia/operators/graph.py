"""Graph operators: components, and shortest paths over line networks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions import lines as L

_LOCAL: dict[str, str] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder that the cluster names, and read back; a
    temporary folder stands in where none is set in a local session."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="meridia-"))
    path = f"{base.rstrip('/')}/meridia-step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of ``links`` (a, b) with the smallest node it reaches.

    Each round replaces a node's links by links to the least node around it, first for
    larger neighbours and then for smaller ones, which takes a number of rounds that
    grows with the logarithm of the longest chain.
    """
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u")
        edges = cut_lineage(small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct())
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(row):
            break
        mark = tuple(row)
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    labels = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = labels.select(F.col("component").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return labels.unionByName(roots)


def network_edges(network: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions; nodes are coordinates in units of 1e-10 degrees, weights planar."""
    key = lambda p: F.struct(F.round(p[0] * 1e10).cast("long").alias("x"), F.round(p[1] * 1e10).cast("long").alias("y"))
    seg = network.filter(G.get_type("geom") == "LineString").select(F.explode(L.segments("geom")).alias("s"))
    one = seg.select(key(F.col("s.a")).alias("src"), key(F.col("s.b")).alias("dst"), F.hypot(F.col("s.b")[0] - F.col("s.a")[0], F.col("s.b")[1] - F.col("s.a")[1]).alias("w"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.filter("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w"))


def shortest_path(network: DataFrame, start: tuple[float, float], end: tuple[float, float], max_distance: float | None = None, max_rounds: int = 10_000) -> DataFrame:
    """One row: cost and the path (geom) between the network's vertices nearest to two
    points, those no farther than ``max_distance`` if it is given; no row if there is none.

    A frontier of improved nodes is joined to the edges, round after round, and only
    improvements below the best known cost to the end go on.
    """
    edges = cut_lineage(network_edges(network))
    nodes = edges.select("src").distinct()

    def snap(p: tuple[float, float]):
        d = F.hypot(F.col("src.x") / 1e10 - p[0], F.col("src.y") / 1e10 - p[1]).alias("d")
        got = nodes.select("src", d).orderBy("d", "src").first()
        return None if got is None or (max_distance is not None and got.d >= max_distance) else got.src

    empty = network.sparkSession.createDataFrame([], "cost double, path array<struct<x:bigint,y:bigint>>")
    a, b = snap(start), snap(end)
    shape = lambda df: df.select("cost", G.linestring(F.transform("path", lambda p: F.array(p["x"] / 1e10, p["y"] / 1e10))).alias("geom"))
    if a is None or b is None or a == b:
        return shape(empty)
    node = lambda v: F.struct(F.lit(v.x).alias("x"), F.lit(v.y).alias("y"))
    best = cut_lineage(network.sparkSession.range(1).select(node(a).alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast("struct<x:bigint,y:bigint>").alias("via")))
    frontier, bound = best, float("inf")
    for _ in range(max_rounds):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("src").alias("via")).filter(F.col("cost") < F.lit(bound))
        offers = step.groupBy("node").agg(F.min(F.struct("cost", "via")).alias("m")).select("node", "m.cost", "m.via")
        known = best.select(F.col("node").alias("n2"), F.col("cost").alias("c2"))
        frontier = cut_lineage(offers.join(known, offers["node"] == known["n2"], "left").filter("c2 is null or cost < c2 - 1e-15").select("node", "cost", "via"))
        if frontier.isEmpty():
            break
        best = cut_lineage(best.unionByName(frontier).groupBy("node").agg(F.min(F.struct("cost", "via")).alias("m")).select("node", "m.cost", "m.via"))
        reached = best.filter(F.col("node") == node(b)).first()
        bound = reached.cost if reached else bound
    else:
        raise RuntimeError(f"the path didn't settle in {max_rounds} rounds")
    reached = best.filter(F.col("node") == node(b)).first()
    if reached is None:
        return shape(empty)
    # Walking back asks for one node at a time; the path is all that comes to the driver.
    path, at = [b], reached.via
    while at is not None:
        path.append(at)
        at = best.filter(F.col("node") == node(at)).first().via
    rows = [(reached.cost, [(p.x, p.y) for p in reversed(path)])]
    return shape(network.sparkSession.createDataFrame(rows, empty.schema))

