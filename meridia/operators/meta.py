"""Iterating and folding over collections: vertices, features, geometries and properties.

The "each" operators are row sets to go on with; the "reduce" ones are aggregates whose
merge must be associative, as partial results of partitions are merged in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.operators.aggregates import coord_reduce, counts, first_coord, last_coord
from meridia.operators.generators import explode_vertices, flatten


def coord_each(features: DataFrame) -> DataFrame:
    """One row per vertex. ``index`` is a feature's ordinal, not the vertex's, which is ``pos``."""
    return explode_vertices(features.withColumn("index", F.col("fid")))


def feature_each(features: DataFrame) -> DataFrame:
    return features


def geom_each(features: DataFrame) -> DataFrame:
    """Features that have a geometry."""
    return features.filter("geom is not null")


def prop_each(features: DataFrame) -> DataFrame:
    """fid and props, an empty bag for none."""
    return features.select("fid", F.coalesce("props", F.parse_json(F.lit("{}"))).alias("props"))


def flatten_each(features: DataFrame) -> DataFrame:
    return flatten(features)


def feature_reduce(features: DataFrame, value: Column, merge: Callable[[Column], Column] = F.sum, by=None) -> DataFrame:
    """One row, or one per group: ``acc``, an aggregate of a value of each feature."""
    keys = [by] if isinstance(by, str) else list(by or [])
    return features.groupBy(*keys).agg(merge(value).alias("acc"))


def geom_reduce(features: DataFrame, value: Column, merge: Callable[[Column], Column] = F.sum, by=None) -> DataFrame:
    return feature_reduce(geom_each(features), value, merge, by)


def prop_reduce(features: DataFrame, value: Column, merge: Callable[[Column], Column] = F.sum, by=None) -> DataFrame:
    return feature_reduce(features, value, merge, by)


def flatten_reduce(features: DataFrame, value: Column, merge: Callable[[Column], Column] = F.sum, by=None) -> DataFrame:
    """Over single parts; one fold over all of them, not one per feature."""
    return feature_reduce(flatten(features), value, merge, by)


def collection_of(features: DataFrame, kind: str) -> DataFrame:
    """The features, each checked to be of one type when it is read."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {kind}, got "), F.coalesce(G.get_type("geom"), F.lit("null"))))
    return features.withColumn("geom", F.when(G.get_type("geom") == kind, F.col("geom")).otherwise(wrong.cast(features.schema["geom"].dataType)))


def with_id(features: DataFrame, value: Column) -> DataFrame:
    return features.withColumn("id", value.cast("string"))


def with_bbox(features: DataFrame, box: Column | None = None) -> DataFrame:
    """A cached box; computed from the geometry if none is given."""
    return features.withColumn("bbox", G.bbox("geom") if box is None else box)


def clone(features: DataFrame) -> DataFrame:
    """Tables can't be changed, so a copy is the table."""
    return features


__all__ = ["clone", "collection_of", "coord_each", "coord_reduce", "counts", "feature_each", "feature_reduce", "first_coord", "flatten_each", "flatten_reduce", "geom_each", "geom_reduce", "last_coord", "prop_each", "prop_reduce", "with_bbox", "with_id"]
