"""Points near other points or in regions (problem 5).

Coordinates become three-dimensional unit vectors, so that the 180th meridian and the poles are
nothing special and a distance is a chord. Space is cut by k-d splits, fitted on a bounded sample;
every point goes to the leaf it lies in and, as a halo copy, to each leaf within the chord radius.
Each leaf is then searched by a local k-d tree. Points at one location are one point of the search and
are expanded by an equi-join, so many rows at one place make no single task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footmesh.functions.geo import EARTH_RADIUS_M, present, unit_vector
from footmesh.operators.snapshots import haversine_np
from footmesh.runtime import cut, map_groups

# The splits are fitted on about SAMPLE locations at most; a leaf is meant to hold LEAF locations, or more where the sample is too thin for that.
SAMPLE = 100_000
LEAF = 4_000
SAMPLE_PER_LEAF = 16
BLOCK = 64
# Edges of regions: cells an edge may touch along an axis before a grid four times as coarse is used, and the coarsest grid.
SPREAD = 16
COARSEST = 8


def fit_splits(sample: np.ndarray, per_leaf: int) -> np.ndarray:
    """Rows (axis, threshold, left, right); axis -1 is a leaf, whose number is in ``left``."""
    nodes: list[list[float]] = []
    leaves = 0

    def build(points: np.ndarray) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0])
        if len(points) > per_leaf:
            axis = int(np.argmax(points.max(0) - points.min(0)))
            cutting = float(np.median(points[:, axis]))
            low = points[:, axis] < cutting
            if low.any() and not low.all():
                nodes[at] = [axis, cutting, build(points[low]), build(points[~low])]
                return at
        nodes[at][2] = leaves
        leaves += 1
        return at

    build(sample)
    return np.array(nodes, float)


def descend(xyz: np.ndarray, nodes: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, leaf, home): every leaf within ``margin`` of each point; home marks the one it lies in."""
    out = []
    at, node, home = np.arange(len(xyz)), np.zeros(len(xyz), int), np.ones(len(xyz), bool)
    while len(at):
        axis = nodes[node, 0].astype(int)
        done = axis < 0
        out.append((at[done], nodes[node[done], 2].astype(int), home[done]))
        at, node, home, axis = at[~done], node[~done], home[~done], axis[~done]
        d = xyz[at, axis] - nodes[node, 1]
        left, right = d < margin, d >= -margin
        at, node, home = (
            np.r_[at[left], at[right]],
            np.r_[nodes[node[left], 2], nodes[node[right], 3]].astype(int),
            np.r_[home[left] & (d[left] < 0), home[right] & (d[right] >= 0)],
        )
    return tuple(np.concatenate(x) for x in zip(*out))


def tree_blocks(xyz: np.ndarray) -> tuple[list[np.ndarray], list[tuple]]:
    """A k-d tree over the points: index blocks of at most BLOCK, and nodes (low corner, high corner, left, right, block)."""
    blocks: list[np.ndarray] = []
    nodes: list[tuple] = []

    def build(idx: np.ndarray) -> int:
        p = xyz[idx]
        low, high = p.min(0), p.max(0)
        at = len(nodes)
        nodes.append(())
        if len(idx) <= BLOCK:
            blocks.append(idx)
            nodes[at] = (low, high, -1, -1, len(blocks) - 1)
            return at
        axis = int(np.argmax(high - low))
        half = len(idx) // 2
        order = np.argpartition(p[:, axis], half)
        nodes[at] = (low, high, build(idx[order[:half]]), build(idx[order[half:]]), -1)
        return at

    if len(xyz):
        build(np.arange(len(xyz)))
    return blocks, nodes


def near_blocks(xyz: np.ndarray, chord: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of index blocks of the k-d tree whose boxes are within ``chord``, each unordered pair once."""
    blocks, nodes = tree_blocks(xyz)
    todo = [(0, 0)] if nodes else []
    while todo:
        a, b = todo.pop()
        na, nb = nodes[a], nodes[b]
        gap = np.maximum(0, np.maximum(na[0] - nb[1], nb[0] - na[1]))
        if gap @ gap > chord * chord:
            continue
        if na[4] >= 0 and nb[4] >= 0:
            yield blocks[na[4]], blocks[nb[4]]
        elif a == b:
            todo += [(na[2], na[2]), (na[2], na[3]), (na[3], na[3])]
        elif nb[4] >= 0 or (na[4] < 0 and (na[1] - na[0]).max() >= (nb[1] - nb[0]).max()):
            todo += [(na[2], b), (na[3], b)]
        else:
            todo += [(a, nb[2]), (a, nb[3])]


def near_locations(locations: DataFrame, radius_m: float) -> DataFrame:
    """``locations``: distinct (lat, lon). Pairs lat_a, lon_a, lat_b, lon_b within the radius, the smaller (lat, lon) first, each location also with itself."""
    x, y, z = unit_vector(F.col("lat"), F.col("lon"))
    n = locations.count()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = locations.sample(fraction=share, seed=7).select(x, y, z).toPandas().to_numpy(float).reshape(-1, 3)
    per_leaf = max(SAMPLE_PER_LEAF, round(LEAF * len(sample) / max(n, 1)))
    splits = fit_splits(sample, per_leaf) if len(sample) else np.array([[-1, 0, 0, 0]], float)
    # a little wider than the radius; the haversine test decides
    chord = 2 * np.sin(min(np.pi, radius_m * 1.0001 / EARTH_RADIUS_M) / 2) + 1e-9

    def vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        p, q = np.radians(lat), np.radians(lon)
        return np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)], 1)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lat, lon = frame["lat"].to_numpy(float), frame["lon"].to_numpy(float)
            at, leaf, home = descend(vectors(lat, lon), splits, chord)
            yield pd.DataFrame({"leaf": leaf.astype(np.int32), "lat": lat[at], "lon": lon[at], "home": home})

    def search(_: tuple, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        lat, lon, home = frame["lat"].to_numpy(), frame["lon"].to_numpy(), frame["home"].to_numpy()
        xyz = vectors(lat, lon)
        held, size = [], 0
        for p, q in near_blocks(xyz, chord):
            near = ((xyz[p][:, None] - xyz[q][None]) ** 2).sum(-1) <= chord * chord
            i, j = np.nonzero(near)
            i, j = p[i], q[j]
            if p is q:
                keep = i <= j
                i, j = i[keep], j[keep]
            # of two leaves that see a pair, the home of its smaller location gives it
            swap = (lat[j] < lat[i]) | ((lat[j] == lat[i]) & (lon[j] < lon[i]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            keep = home[i]
            i, j = i[keep], j[keep]
            keep = (i == j) | (haversine_np(lat[i], lon[i], lat[j], lon[j]) <= radius_m)
            i, j = i[keep], j[keep]
            held.append((i, j))
            size += len(i)
            if size > 100_000:
                i, j = (np.concatenate(v) for v in zip(*held))
                yield pd.DataFrame({"lat_a": lat[i], "lon_a": lon[i], "lat_b": lat[j], "lon_b": lon[j]})
                held, size = [], 0
        if held:
            i, j = (np.concatenate(v) for v in zip(*held))
            yield pd.DataFrame({"lat_a": lat[i], "lon_a": lon[i], "lat_b": lat[j], "lon_b": lon[j]})

    leaves = locations.mapInPandas(assign, "leaf int, lat double, lon double, home boolean")
    return map_groups(leaves, ["leaf"], search, "lat_a double, lon_a double, lat_b double, lon_b double")


def near_pairs(points: DataFrame, key: str, lat: str, lon: str, radius_m: float) -> DataFrame:
    """id_a, id_b: every two different keys within the radius, the smaller first, each pair once.

    Rows with a null key, a null or NaN coordinate or with both coordinates zero don't count; other
    coordinates are taken as they stand. A key at several places is near what any of them is near.
    Repeated rows count once. Empty tables give no pairs.
    """
    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    rows = points.where(F.col(key).isNotNull() & present(la, lo) & ~((la == 0) & (lo == 0))).select(F.col(key).alias("id"), la.alias("lat"), lo.alias("lon")).distinct()
    rows = cut(rows)
    pairs = near_locations(cut(rows.select("lat", "lon").distinct()), radius_m)
    a = rows.select(F.col("id").alias("x"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    b = rows.select(F.col("id").alias("y"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    out = pairs.join(a, ["lat_a", "lon_a"]).join(b, ["lat_b", "lon_b"]).where("x <> y")
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def sweep_rings(px: np.ndarray, py: np.ndarray, ex0: np.ndarray, ey0: np.ndarray, ex1: np.ndarray, ey1: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plane sweep from west to east: (point, region) where the point lies in the region, by the parity of the edges above it.

    Edges are half open, from their west end on and short of their east end, so a vertex counts once.
    """
    flip = ex0 > ex1
    x0, y0, x1, y1 = np.where(flip, ex1, ex0), np.where(flip, ey1, ey0), np.where(flip, ex0, ex1), np.where(flip, ey0, ey1)
    order = np.argsort(x0, kind="stable")
    x0, y0, x1, y1, region = x0[order], y0[order], x1[order], y1[order], region[order]
    by_x = np.argsort(px, kind="stable")
    active = np.empty(0, int)
    into, out_p, out_r = 0, [], []
    for start in range(0, len(by_x), BLOCK):
        part = by_x[start : start + BLOCK]
        first, last = px[part[0]], px[part[-1]]
        upto = np.searchsorted(x0, last, side="right")
        active = np.r_[active, np.arange(into, upto)]
        into = upto
        active = active[x1[active] > first]
        if not len(active):
            continue
        x, y = px[part][:, None], py[part][:, None]
        spans = (x0[active] <= x) & (x < x1[active])
        with np.errstate(divide="ignore", invalid="ignore"):
            above = y0[active] + (x - x0[active]) / (x1[active] - x0[active]) * (y1[active] - y0[active]) > y
        i, j = np.nonzero(spans & above)
        if len(i):
            hit, n = np.unique(np.stack([part[i], region[active[j]]], 1), axis=0, return_counts=True)
            odd = hit[n % 2 == 1]
            out_p.append(odd[:, 0])
            out_r.append(odd[:, 1])
    return (np.concatenate(out_p), np.concatenate(out_r)) if out_p else (np.empty(0, int), np.empty(0, int))


def points_in_regions(points: DataFrame, key: str, lat: str, lon: str, regions: DataFrame, region_key: str, ring: str, cell_deg: float = 0.05) -> DataFrame:
    """(id, region_id): the regions that contain each point; ``ring`` is array<struct<lat, lon>>, open or closed.

    Regions are cut by cell of a fixed grid: a cell holds the edges that cross its columns at or above
    it, collected only for the regions whose box meets the cell. Only cells that hold points get edges,
    so a region may be as large as the globe. Points on a west or south border are inside, on an east or
    north border outside. Null, NaN and zero coordinates and rings of fewer than three points contain
    nothing. A region may have several rings that don't overlap; one over the 180th meridian is given as
    two, either of which may run on past the meridian.
    """
    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    pts = points.where(F.col(key).isNotNull() & present(la, lo) & ~((la == 0) & (lo == 0))).select(F.col(key).alias("id"), la.alias("py"), lo.alias("px")).distinct()
    cell = lambda c: F.floor(c / cell_deg).cast("bigint")
    pts = pts.withColumns({"cx": cell(F.col("px")), "cy": cell(F.col("py"))})
    rings = regions.where(F.size(ring) >= 3).select(F.col(region_key).alias("region_id"), F.col(ring).alias("ring"))
    closed = F.concat(F.col("ring"), F.slice("ring", 1, 1))
    edges = rings.select("region_id", F.array_min(F.col("ring.lat")).alias("south"), F.explode(F.arrays_zip(F.col("ring").alias("a"), F.slice(closed, 2, F.size("ring")).alias("b"))).alias("e"))
    edges = edges.select("region_id", "south", F.col("e.a.lon").alias("x0"), F.col("e.a.lat").alias("y0"), F.col("e.b.lon").alias("x1"), F.col("e.b.lat").alias("y1")).where("x0 <> x1")
    # an edge decides for the points below it, down to the region's southern end
    edges = edges.withColumns({"cx0": cell(F.least("x0", "x1")), "cx1": cell(F.greatest("x0", "x1")), "cy0": cell(F.col("south")), "cy1": cell(F.greatest("y0", "y1"))}).drop("south")
    # long edges meet the cells that hold points by way of a coarser grid, in which an edge touches few cells
    wide = F.greatest(F.col("cx1") - F.col("cx0"), F.col("cy1") - F.col("cy0")) + 1
    edges = edges.withColumn("level", F.least(F.lit(COARSEST), F.greatest(F.lit(0), F.ceil(F.log2(wide / SPREAD) / 2))).cast("int"))
    coarse = lambda c: F.expr(f"shiftright({c}, 2 * level)")
    edges = edges.withColumn("kx", F.explode(F.sequence(coarse("cx0"), coarse("cx1"))))
    edges = edges.withColumn("ky", F.explode(F.sequence(coarse("cy0"), coarse("cy1"))))
    held = pts.select(F.col("cx").alias("hx"), F.col("cy").alias("hy")).distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(COARSEST))))
    held = held.withColumns({"kx": coarse("hx"), "ky": coarse("hy")})
    edges = edges.join(held, ["level", "kx", "ky"]).where("hx between cx0 and cx1 and hy between cy0 and cy1")
    edges = edges.select("region_id", "x0", "y0", "x1", "y1", "hx", "hy")

    def sweep(_: tuple, p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if p.empty or e.empty:
            return pd.DataFrame({"id": pd.Series([], dtype=object), "region_id": pd.Series([], dtype=object)})
        codes, names = pd.factorize(e["region_id"].to_numpy(object))
        i, r = sweep_rings(p["px"].to_numpy(), p["py"].to_numpy(), *(e[c].to_numpy() for c in ("x0", "y0", "x1", "y1")), codes)
        return pd.DataFrame({"id": p["id"].to_numpy(object)[i], "region_id": names[r]})

    schema = f"id {dict(pts.dtypes)['id']}, region_id {dict(rings.dtypes)['region_id']}"
    return pts.groupBy("cx", "cy").cogroup(edges.groupBy("hx", "hy")).applyInPandas(lambda k, p, e: sweep(k, p, e), schema).distinct()
