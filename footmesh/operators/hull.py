"""Hulls of point groups: the one kernel that column expressions can't express.

The concave hull follows Park and Oh (2012), with a queue of edges: from the convex hull, an edge is dug
inward to the nearest inner point that is nearer to it than to its neighbours and can be joined to both its
ends without crossing the ring, if that point is near enough against the edge's length.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footmesh.functions.geo import METERS_PER_DEGREE, MIN_LON_SCALE
from footmesh.runtime import map_groups

CONCAVITY = 2.2


def convex_ring(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the lowest (x, y); points on its sides are left out."""
    pts = points[np.lexsort((points[:, 1], points[:, 0]))]
    if len(pts) < 3:
        return pts

    def half(ps) -> list:
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts.tolist()) + half(pts[::-1].tolist()))


def gap(x: np.ndarray, y: np.ndarray, ax: float, ay: float, bx: float, by: float) -> np.ndarray:
    """Squared distances of points from the segment a-b."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = np.clip(((x - ax) * dx + (y - ay) * dy) / size, 0, 1) if size else np.zeros(len(x))
    return (x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2


def crosses(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> bool:
    """Whether a-b properly crosses any of the segments c-d; what only touches does not cross."""
    side = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    return bool(np.any((side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)))


class Ring:
    """A ring under change: corners, their successors, and the edges as arrays for vectorised crossing tests."""

    def __init__(self, xy: np.ndarray, corners: np.ndarray):
        n = len(corners)
        self.x, self.y = xy[:, 0], xy[:, 1]
        self.point = list(corners)
        self.next, self.prev = [(k + 1) % n for k in range(n)], [(k - 1) % n for k in range(n)]
        # edge k leads from corner k to the next one; room for every point to become a corner
        self.edges = np.empty((len(xy) + 1, 4))
        for k in range(n):
            self._draw(k)

    def _draw(self, k: int) -> None:
        a, b = self.point[k], self.point[self.next[k]]
        self.edges[k] = self.x[a], self.y[a], self.x[b], self.y[b]

    def insert(self, k: int, p: int) -> int:
        """Put point ``p`` between corner ``k`` and the next one."""
        new, after = len(self.point), self.next[k]
        self.point.append(p)
        self.next.append(after)
        self.prev.append(k)
        self.next[k], self.prev[after] = new, new
        self._draw(k)
        self._draw(new)
        return new

    def free(self, a: int, p: int) -> bool:
        """Whether the segment from corner point ``a`` to ``p`` meets no edge; edges that end in ``a`` don't count."""
        ax, ay, px, py = self.x[a], self.y[a], self.x[p], self.y[p]
        e = self.edges[: len(self.point)]
        near = (np.minimum(e[:, 0], e[:, 2]) <= max(ax, px)) & (np.maximum(e[:, 0], e[:, 2]) >= min(ax, px)) & (np.minimum(e[:, 1], e[:, 3]) <= max(ay, py)) & (np.maximum(e[:, 1], e[:, 3]) >= min(ay, py))
        u, v, s, t = e[near].T
        one = ((s - u) * (ay - v) - (t - v) * (ax - u) > 0) != ((s - u) * (py - v) - (t - v) * (px - u) > 0)
        two = ((px - ax) * (v - ay) - (py - ay) * (u - ax) > 0) != ((px - ax) * (t - ay) - (py - ay) * (s - ax) > 0)
        apart = ~((s == ax) & (t == ay)) & ~((u == px) & (v == py))
        return not bool((one & two & apart).any())

    def corners(self) -> list[int]:
        out, k = [], 0
        while True:
            out.append(self.point[k])
            k = self.next[k]
            if k == 0:
                return out


def concave_ring(points: np.ndarray, concavity: float = CONCAVITY) -> np.ndarray:
    """The ring of the concave hull, open; depends on the set of points only. Fewer than three corners: no ring."""
    pts = np.unique(points, axis=0)
    hull = convex_ring(pts)
    if len(hull) < 3:
        return np.empty((0, 2))
    place = {tuple(p): k for k, p in enumerate(pts.tolist())}
    corners = np.array([place[tuple(p)] for p in hull.tolist()])
    x, y = pts[:, 0], pts[:, 1]
    free = np.ones(len(pts), bool)
    free[corners] = False
    ring = Ring(pts, corners)
    todo = deque(range(len(corners)))
    while todo:
        k = todo.popleft()
        a, b = ring.point[k], ring.point[ring.next[k]]
        ax, ay, bx, by = x[a], y[a], x[b], y[b]
        limit = float((bx - ax) ** 2 + (by - ay) ** 2) / concavity**2
        reach = limit**0.5
        # points are in order of x, so only a slice of them can be near
        low, high = np.searchsorted(x, min(ax, bx) - reach), np.searchsorted(x, max(ax, bx) + reach, side="right")
        idx = low + np.flatnonzero(free[low:high] & (y[low:high] >= min(ay, by) - reach) & (y[low:high] <= max(ay, by) + reach))
        if not len(idx):
            continue
        d = gap(x[idx], y[idx], ax, ay, bx, by)
        near = d <= limit
        idx, d = idx[near], d[near]
        before, after = ring.point[ring.prev[k]], ring.point[ring.next[ring.next[k]]]
        own = (d < gap(x[idx], y[idx], x[before], y[before], ax, ay)) & (d < gap(x[idx], y[idx], bx, by, x[after], y[after]))
        idx, d = idx[own], d[own]
        # the first that can be joined is the candidate; whether it is near enough to an end settles the edge
        p = next((c for c in idx[np.lexsort((y[idx], x[idx], d))] if ring.free(a, c) and ring.free(b, c)), None)
        if p is not None and min((x[p] - ax) ** 2 + (y[p] - ay) ** 2, (x[p] - bx) ** 2 + (y[p] - by) ** 2) <= limit:
            free[p] = False
            new = ring.insert(k, int(p))
            todo += [k, new]
    return pts[ring.corners()]


def hulls(points: DataFrame, concave: bool = True) -> DataFrame:
    """``points``: request_id, c_lat, c_lon, x, y. The open ring around each request's points: request_id, pos, lat, lon.

    Where the concave hull has fewer than three corners the convex one is taken. A request with fewer than
    three distinct points, or with all of them on a line, has no ring.
    """

    def run(key: tuple, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        xy = frame[["x", "y"]].to_numpy(float)
        ring = concave_ring(xy) if concave else np.empty((0, 2))
        if len(ring) < 3:
            ring = convex_ring(np.unique(xy, axis=0))
        if len(ring) < 3:
            return
        la, lo = float(frame["c_lat"].iloc[0]), float(frame["c_lon"].iloc[0])
        scale = METERS_PER_DEGREE * max(MIN_LON_SCALE, np.cos(np.radians(la)))
        yield pd.DataFrame({"request_id": key[0], "pos": np.arange(len(ring), dtype=np.int32), "lat": la + ring[:, 1] / METERS_PER_DEGREE, "lon": lo + ring[:, 0] / scale})

    return map_groups(points.select("request_id", "c_lat", "c_lon", F.col("x") + 0.0, F.col("y") + 0.0).toDF("request_id", "c_lat", "c_lon", "x", "y"), ["request_id"], run, "request_id string, pos int, lat double, lon double", ["x", "y"])
