"""Kernels as columns: Arrow batches in and out, one call per row."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from meridia.kernels import overlay as O
from meridia.kernels import planar as K
from meridia.schema import GEOM_DDL

GEOMS_DDL = f"array<{GEOM_DDL}>"


def arrow_function(f: Callable, ddl: str) -> Callable:
    """``f`` over rows, where a null argument makes a null result, as a function of columns."""
    kind = to_arrow_type(T._parse_datatype_string(ddl))

    def run(*args: pa.Array) -> pa.Array:
        return pa.array([None if any(v is None for v in row) else f(*row) for row in zip(*(a.to_pylist() for a in args), strict=True)], kind)

    run.__annotations__ = {"args": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ddl)


def kernel(f: Callable, ddl: str, *columns) -> Column:
    return arrow_function(f, ddl)(*(F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c) for c in columns))


def simplify(g, tolerance: float, high_quality: bool = False) -> Column:
    """Douglas-Peucker; ``high_quality`` is accepted and makes no difference."""
    if tolerance <= 0:
        raise ValueError("tolerance must be positive")
    return kernel(lambda x: K.simplify(x, tolerance), GEOM_DDL, g)


def nearest_on_path(p, path) -> Column:
    """Struct (dist in metres, index of the segment, x, y); null under two positions."""
    return kernel(lambda v, q: K.nearest_on_path(v, q) if len(v) > 1 and None not in v[:2] else None, "struct<dist: double, index: int, x: double, y: double>", p, path)


def line_offset(g, distance: float, unit: str = "kilometers") -> Column:
    return kernel(lambda x: K.line_offset(x, distance, unit), GEOM_DDL, g)


def chunks(g, step: float, mode: str) -> Column:
    return kernel(lambda x: K.chunks(x, step, mode == "corrected"), GEOMS_DDL, g)


def box_clip(g, box, mode: str = "reference") -> Column:
    box = list(box)
    if len(box) < 4:
        raise ValueError("a box has four numbers")
    return kernel(lambda x: K.box_clip(x, box, mode), GEOM_DDL, g)


def buffer(g, radius: float, unit: str = "kilometers", steps: int = 16, mode: str = "reference") -> Column:
    """Points become circles, MultiPoints the union of theirs; see the kernel for the rest."""
    if radius <= 0:
        raise ValueError("radius must be positive")
    steps = steps if steps > 2 else 16
    return kernel(lambda x: K.buffer(x, radius, unit, steps, mode), GEOM_DDL, g)


def tangents(p, g) -> Column:
    """Array of the two tangent vertices, left then right."""
    from meridia.functions import geometry as G

    return kernel(K.tangents, "array<array<double>>", G.get_coord(p), g)


def combine(a, b, operation: str) -> Column:
    if operation not in ("union", "intersect", "difference", "xor"):
        raise ValueError(f"no operation {operation!r}")
    return kernel(lambda x, y: O.combine(x, y, operation), GEOM_DDL, a, b)


def polygon_union(a, b) -> Column:
    return combine(a, b, "union")


def polygon_intersect(a, b) -> Column:
    return combine(a, b, "intersect")


def polygon_difference(a, b) -> Column:
    return combine(a, b, "difference")


def polygon_xor(a, b) -> Column:
    return combine(a, b, "xor")


def union_all(geometries) -> Column:
    """The union of an array of geometries."""
    return kernel(O.union_all, GEOM_DDL, geometries)


def tessellate(g, mode: str = "reference") -> Column:
    """Array of triangles of a Polygon; null for other types."""
    return kernel(lambda x: K.tessellate(x, mode) if x["type"] == "Polygon" else None, GEOMS_DDL, g)


def unkink(g) -> Column:
    """Array of simple polygons."""
    return kernel(O.unkinked, GEOMS_DDL, g)


def convex_hull(g) -> Column:
    """Hull of one geometry's vertices; null for under three."""
    from meridia.functions import geometry as G

    return kernel(lambda ps: K.convex_hull(ps) if len(ps) >= 3 else None, GEOM_DDL, G.positions(g))
