"""The map's view: what is visible, what may be loaded, and which stops share a request."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmesh.functions.geo import METERS_PER_DEGREE, MIN_LON_SCALE
from footmesh.functions.scalars import BUCKETS, PADDING_M, pad_box
from footmesh.operators.snapshots import haversine_np
from footmesh.runtime import map_groups

# Stops a request may cover, metres from the first of them, and how much larger its area may be than the first one's alone.
BATCH_STOPS, BATCH_M, GROWTH = 48, 1_600.0, 10.0


def box_for_stop(lat: Column, lon: Column, radius: Column) -> list[Column]:
    """The box that holds all that is within the radius of one stop, with the safety margin: south, west, north, east."""
    return pad_box(lat, lon, lat, lon, radius + PADDING_M)


def nodes_in_boxes(boxes: DataFrame, nodes: DataFrame, cell_deg: float = 0.005) -> DataFrame:
    """``boxes``: key, south, west, north, east; ``nodes``: area_id, id, lat, lon. The single-stop scan: key and the nodes in its box, borders included.

    By equi-join on the cells that a box touches; boxes wider than half the globe are cut at its ends.
    """
    at = lambda c: F.floor(c / cell_deg).cast("bigint")
    spread = boxes.where("south <= north and west <= east").withColumn("cy", F.explode(F.sequence(at(F.greatest(F.col("south"), F.lit(-90.0))), at(F.least(F.col("north"), F.lit(90.0))))))
    spread = spread.withColumn("cx", F.explode(F.sequence(at(F.greatest(F.col("west"), F.lit(-360.0))), at(F.least(F.col("east"), F.lit(360.0))))))
    held = nodes.withColumns({"cy": at(F.col("lat")), "cx": at(F.col("lon"))})
    return spread.join(held, ["cy", "cx"]).where("lat between south and north and lon between west and east").select("key", "area_id", "id", "lat", "lon")


def eligible(stops: DataFrame, polygons: DataFrame, active: DataFrame, queued: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """Stops that may be queued: without a polygon, not being loaded or queued, and without a failure that still holds. Each of the others: id; ``failed`` also retry_at."""
    out = stops
    for other in (polygons, active, queued, failed.where(F.col("retry_at") > now)):
        out = out.join(other.select("id").distinct(), "id", "left_anti")
    return out


def still_current(asked: DataFrame, now: DataFrame) -> DataFrame:
    """``asked``: id, generation, radius_m, lat, lon; ``now``: id, generation, radius_m, lat, lon, visible. Adds ``current``: nothing of it changed and it is in view."""
    same = F.lit(True)
    for c in ("generation", "radius_m", "lat", "lon"):
        same = same & F.coalesce(F.col(f"a.{c}") == F.col(f"n.{c}"), F.lit(False))
    return asked.alias("a").join(now.alias("n"), "id", "left").select("a.*", (same & F.coalesce("n.visible", F.lit(False))).alias("current"))


def progress(visible: DataFrame, polygons: DataFrame, failed: DataFrame, now: Column, group: str = "view_id") -> DataFrame:
    """``visible``: group, id. A row a view: total of its visible stops, loaded, unavailable (failed and not yet due again) and pending."""
    have = polygons.select("id").distinct().withColumn("have", F.lit(True))
    off = failed.where(F.col("retry_at") > now).select("id").distinct().withColumn("off", F.lit(True))
    rows = visible.select(group, "id").distinct().join(have, "id", "left").join(off, "id", "left").groupBy(group)
    out = rows.agg(F.count("*").alias("total"), F.count_if("have").alias("loaded"), F.count_if(F.col("have").isNull() & F.coalesce("off", F.lit(False))).alias("unavailable"))
    return out.withColumn("pending", F.col("total") - F.col("loaded") - F.col("unavailable"))


def record_changed(new: DataFrame, old: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """A row a group, ``changed``: whether any key's value differs; an absent key is a null."""
    both = new.select(group, key, F.col(value).alias("_n")).join(old.select(group, key, F.col(value).alias("_o")), [group, key], "full_outer")
    return both.groupBy(group).agg(F.bool_or(~F.col("_n").eqNullSafe(F.col("_o"))).alias("changed"))


def box_area(lat: np.ndarray, lon: np.ndarray, s: float, w: float, n: float, e: float, bucket: float) -> np.ndarray:
    """Rough square metres of the padded query area of the box (s, w, n, e) widened to each point in turn."""
    south, north = np.floor(np.minimum(s, lat) * 1000) / 1000, np.ceil(np.maximum(n, lat) * 1000) / 1000
    west, east = np.floor(np.minimum(w, lon) * 1000) / 1000, np.ceil(np.maximum(e, lon) * 1000) / 1000
    pad = (bucket + PADDING_M) / METERS_PER_DEGREE
    south, north = south - pad, north + pad
    scale = lambda x: METERS_PER_DEGREE * np.maximum(MIN_LON_SCALE, np.cos(np.radians(x)))
    across = (bucket + PADDING_M) / scale(np.maximum(np.abs(south), np.abs(north)))
    return np.maximum(0, north - south) * METERS_PER_DEGREE * np.maximum(0, east + across - west + across) * scale((south + north) / 2)


def bucket_of(radius: float) -> float:
    return next((float(b) for b in BUCKETS if radius <= b), max(float(radius), float(BUCKETS[-1])))


def form_batches(lat: np.ndarray, lon: np.ndarray, radius: np.ndarray, priority: np.ndarray, centre: tuple[float, float]) -> np.ndarray:
    """The number of the request each queued stop goes with.

    The first of a batch is the next stop of priority, or else the one nearest to the centre. Others of its
    radius bucket join by distance, up to 48, within 1,600 m, as long as the area stays within ten times
    the first one's; those passed over wait for a later batch. Ties go by the order given.
    """
    out = np.full(len(lat), -1)
    buckets = np.array([bucket_of(r) for r in radius])
    score = (lat - centre[0]) ** 2 + ((lon - centre[1]) * np.cos(np.radians(centre[0]))) ** 2
    turn = np.lexsort((np.arange(len(lat)), np.where(priority, 0, score), ~priority))
    number = 0
    for first in turn:
        if out[first] >= 0:
            continue
        out[first] = number
        # only what is near enough to count is looked at
        left = np.flatnonzero((out < 0) & (buckets == buckets[first]) & (np.abs(lat - lat[first]) <= 0.02))
        d = haversine_np(lat[first], lon[first], lat[left], lon[left])
        left, d = left[d <= BATCH_M], d[d <= BATCH_M]
        s = n = lat[first]
        w = e = lon[first]
        most = GROWTH * float(box_area(lat[first : first + 1], lon[first : first + 1], s, w, n, e, buckets[first])[0])
        size = 1
        for at in left[np.argsort(d, kind="stable")]:
            if size >= BATCH_STOPS:
                break
            if float(box_area(lat[at : at + 1], lon[at : at + 1], s, w, n, e, buckets[first])[0]) > most:
                continue
            out[at] = number
            size += 1
            s, n, w, e = min(s, lat[at]), max(n, lat[at]), min(w, lon[at]), max(e, lon[at])
        number += 1
    return out


def greedy_batches(queued: DataFrame, views: DataFrame) -> DataFrame:
    """``queued``: view_id, id, lat, lon, radius_m, priority; ``views``: view_id, c_lat, c_lon. view_id, id, batch_no.

    A view is what one screen shows, so its queue is a bounded group. Repeated ids of a view count once.
    """

    def run(key: tuple, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        frame = frame.drop_duplicates("id")
        got = form_batches(*(frame[c].to_numpy(float) for c in ("lat", "lon", "radius_m")), frame["priority"].to_numpy(bool), (float(frame["c_lat"].iloc[0]), float(frame["c_lon"].iloc[0])))
        yield pd.DataFrame({"view_id": frame["view_id"].to_numpy(), "id": frame["id"].to_numpy(), "batch_no": got.astype(np.int64)})

    rows = queued.join(F.broadcast(views), "view_id").select("view_id", "id", "lat", "lon", "radius_m", "priority", "c_lat", "c_lon")
    kinds = dict(rows.dtypes)
    return map_groups(rows, ["view_id"], run, f"view_id {kinds['view_id']}, id {kinds['id']}, batch_no bigint", ["id", "lat", "lon"])
