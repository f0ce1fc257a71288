"""GeoJSON in and out.

Features are rows: fid, id, geom, props (VARIANT) and the raw geometry as text, from which
anything the columns can't hold is written again as it came. A GeometryCollection has
no fixed depth, so its geom is null and its members are rows of ``members``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions.kernels import kernel
from meridia.schema import GEOM_DDL

TYPES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection")


def geometry_from_json(text: Column) -> Column:
    """A geometry column from a GeoJSON geometry's text; null for null, a collection, or what doesn't parse."""
    kind = F.get_json_object(text, "$.type")
    raw = F.get_json_object(text, "$.coordinates")
    get = lambda ddl: F.from_json(raw, ddl)
    one, two, three, four = (get("array<" * k + "double" + ">" * k) for k in (1, 2, 3, 4))
    coords = (
        F.when(kind == "Point", F.array(F.array(F.array(one))))
        .when(kind.isin("MultiPoint", "LineString"), F.array(F.array(two)))
        .when(kind.isin("MultiLineString", "Polygon"), F.array(three))
        .when(kind == "MultiPolygon", four)
    )
    return F.when(coords.isNotNull() & raw.isNotNull(), F.struct(kind.alias("type"), coords.alias("coords")).cast(GEOM_DDL))


def geometry_to_json(g) -> Column:
    g = F.col(g) if isinstance(g, str) else g
    c = g["coords"]
    text = lambda kind, x: F.to_json(F.struct(F.lit(kind).alias("type"), x.alias("coordinates")))
    t = g["type"]
    return (
        F.when(t == "Point", text("Point", F.get(G.path(g), F.lit(0))))
        .when(t == "MultiPoint", text("MultiPoint", G.path(g)))
        .when(t == "LineString", text("LineString", G.path(g)))
        .when(t == "MultiLineString", text("MultiLineString", G.rings(g)))
        .when(t == "Polygon", text("Polygon", G.rings(g)))
        .when(t == "MultiPolygon", text("MultiPolygon", c))
    )


def _feature_rows(docs: DataFrame) -> DataFrame:
    """From (doc, value): a Feature is a row, a FeatureCollection its features, a bare geometry a feature without properties."""
    kind = F.get_json_object("value", "$.type")
    # Items stay text: parsing them to a fixed schema would lose foreign depths and types.
    many = F.transform(F.from_json(F.get_json_object("value", "$.features"), "array<variant>"), lambda v: F.to_json(v))
    bare = F.concat(F.lit('{"type":"Feature","geometry":'), F.col("value"), F.lit("}"))
    items = F.when(kind == "FeatureCollection", many).when(kind == "Feature", F.array("value")).when(kind.isin(*TYPES), F.array(bare))
    rows = docs.select("doc", F.posexplode(items).alias("pos", "f"))
    shape = F.get_json_object("f", "$.geometry")
    box = F.from_json(F.get_json_object("f", "$.bbox"), "array<double>")
    return rows.select(
        "doc", "pos", F.get_json_object("f", "$.id").alias("id"), geometry_from_json(shape).alias("geom"),
        F.parse_json(F.coalesce(F.get_json_object("f", "$.properties"), F.lit("{}"))).alias("props"), box.alias("bbox"), shape.alias("geometry_json"),
    )


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features of GeoJSON files. With ``lines`` every line is a Feature (or geometry) and
    files are split over tasks; otherwise each file is one document. fid is unique, and in
    a document it follows the order of the features."""
    if lines:
        docs = spark.read.text(path).filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("doc"), "value")
    else:
        docs = spark.read.text(path, wholetext=True).select(F.monotonically_increasing_id().alias("doc"), "value")
    rows = _feature_rows(docs)
    fid = F.col("doc") if lines else F.monotonically_increasing_id()
    return rows.select(fid.alias("fid"), "id", "geom", "props", "bbox", "geometry_json")


def from_json_column(docs: DataFrame, text: str = "value") -> DataFrame:
    """Features of a table of GeoJSON documents."""
    rows = _feature_rows(docs.select(F.monotonically_increasing_id().alias("doc"), F.col(text).alias("value")))
    return rows.select(F.monotonically_increasing_id().alias("fid"), "id", "geom", "props", "bbox", "geometry_json")


def feature_json(geom="geom", props="props", fid: str | None = None, bbox: str | None = None) -> Column:
    """A feature's text: geometry always (null if there is none), id and bbox only if set."""
    shape = F.coalesce(geometry_to_json(geom), F.lit("null"))
    parts = [F.lit('{"type":"Feature"')]
    if fid:
        parts.append(F.when(F.col(fid).isNotNull(), F.concat(F.lit(',"id":'), F.to_json(F.struct(F.col(fid).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(fid).alias("v")))) - 6))).otherwise(""))
    if bbox:
        parts.append(F.when(F.size(bbox) > 0, F.concat(F.lit(',"bbox":'), F.to_json(bbox))).otherwise(""))
    body = F.coalesce(F.to_json(F.col(props)), F.lit("{}")) if props else F.lit("{}")
    return F.concat(*parts, F.lit(',"geometry":'), shape, F.lit(',"properties":'), body, F.lit("}"))


def write_geojson(features: DataFrame, path: str, fid: str | None = None) -> None:
    """One Feature on each line, written by all tasks."""
    props = "props" if "props" in features.columns else None
    features.select(feature_json("geom", props, fid).alias("value")).write.mode("overwrite").text(path)


def collection_json(features: DataFrame, fid: str | None = None, limit: int = 1_000_000) -> str:
    """A FeatureCollection as one text, for collections of no more than ``limit`` features."""
    props = "props" if "props" in features.columns else None
    rows = features.orderBy("fid").select(feature_json("geom", props, fid).alias("v")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} features; write them one on a line instead")
    return '{"type":"FeatureCollection","features":[' + ",".join(r.v for r in rows) + "]}"


def _members(text: str) -> list[dict]:
    """The single geometries of a geometry's text, with their places in nested collections."""
    out, todo = [], [([], json.loads(text))]
    while todo:
        path, shape = todo.pop()
        if isinstance(shape, dict) and shape.get("type") == "GeometryCollection":
            todo += [([*path, k], x) for k, x in reversed(list(enumerate(shape.get("geometries") or [])))]
        else:
            out.append({"path": path, "g": json.dumps(shape)})
    return out


def members(features: DataFrame) -> DataFrame:
    """One row per member geometry: fid, path (where it is in nested collections, however
    deep), geom. Other geometries are their own member, with an empty path."""
    parts = kernel(_members, "array<struct<path:array<int>,g:string>>", "geometry_json")
    rows = features.select("fid", F.explode(parts).alias("m"))
    return rows.select("fid", "m.path", geometry_from_json(F.col("m.g")).alias("geom"))


def collection_of_geometries(geoms: Column) -> Column:
    """The text of a GeometryCollection of an array of geometries; texts of collections nest
    by ``nested_collection``."""
    return nested_collection(F.transform(geoms, geometry_to_json))


def nested_collection(texts: Column) -> Column:
    return F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(texts, ","), F.lit("]}"))


def number(props: str, name: str) -> Column:
    """A numeric property as a double; null for anything that isn't a JSON number."""
    v = F.try_variant_get(props, f"$.{name}", "variant")
    kind = F.schema_of_variant(v)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.try_variant_get(props, f"$.{name}", "double"))
