"""Spatial operators on streams.

All functions on columns run on streaming DataFrames as they are; so does a tag join with
a static table of zones. ``enter_leave`` goes further and keeps each key's zone in state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.plans.spatial_join import point_polygon_pairs


def tag_stream(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Stream (lng, lat, ...) joined with the static zones (zid, geom) that hold each point."""
    return point_polygon_pairs(points, zones.select("zid", "geom"), strategy="auto").drop("geom")


def zone_counts(points: DataFrame, zones: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Points per zone and window, final once the watermark has passed."""
    tagged = tag_stream(points.withWatermark(ts, late), zones)
    return tagged.groupBy(F.window(ts, window), "zid").agg(F.count(F.lit(1)).alias("n"))


def _moves(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    # Dealt to several levels, an event has several rows, of which one may know the zone.
    rows = pd.concat(list(frames)).groupby(["ts", "event_id"], sort=True, as_index=False)["zid"].max()
    out = []
    for r in rows.itertuples():
        zone = None if pd.isna(r.zid) else int(r.zid)
        if zone != last:
            if last is not None:
                out.append((key[0], r.ts, last, "leave"))
            if zone is not None:
                out.append((key[0], r.ts, zone, "enter"))
        last = zone
    state.update((last,))
    yield pd.DataFrame(out, columns=["user_id", "ts", "zid", "move"])


def enter_leave(points: DataFrame, zones: DataFrame, strategy: str = "auto") -> DataFrame:
    """Stream (user_id, event_id, ts, lng, lat) to the moves into and out of zones. State is
    one zone for each user; zones must not overlap."""
    events = points.select("user_id", "event_id", "ts", "lng", "lat")
    tagged = point_polygon_pairs(events, zones.select("zid", "geom"), strategy=strategy, how="left").select("user_id", "event_id", "ts", "zid")
    return tagged.groupBy("user_id").applyInPandasWithState(_moves, "user_id long, ts timestamp, zid long, move string", "zid long", "append", "NoTimeout")
