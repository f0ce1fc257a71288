"""Connected components of a link table, without ever gathering it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest id it reaches.

    Rounds of large-star and small-star; each round's links are written and read
    back. The least neighbour of a node combines before the shuffle, and joining it
    back to the links of a hot node is a skewed join that is split at run time.
    """
    ordered = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = written(ordered.distinct(), "links")
    mark = _mark(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = written(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
        now = _mark(after)
        dropped(edges)
        edges = after
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    labels = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node")).distinct().join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return labels.unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """A count and a checksum; equal when a round has changed nothing."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s
