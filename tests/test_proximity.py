import math
import random

import numpy as np

from footmesh.operators import proximity as P
from footmesh.operators.snapshots import haversine_np
from footmesh.plans.general import p5_region


def brute(points, radius):
    out = set()
    good = [(k, a, b) for k, a, b in points if k is not None and a is not None and b is not None and not math.isnan(a) and not math.isnan(b) and (a or b)]
    for i, (k, a, b) in enumerate(good):
        for m, c, d in good[i + 1 :]:
            if k != m and haversine_np(np.array(a), np.array(b), np.array(c), np.array(d)) <= radius:
                out.add((min(k, m), max(k, m)))
    return out


def run(spark, points, radius):
    df = spark.createDataFrame([(*p, 1.0) for p in points], "id string, lat double, lon double, lat_a double")
    got = [tuple(r) for r in P.near_pairs(df, "id", "lat", "lon", radius).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAF", 20)
    rng = random.Random(1)
    pts = [(f"p{k}", 46 + rng.random() * 0.02, 7 + rng.random() * 0.02) for k in range(300)]
    pts += [(f"d{k}", 17.0, rng.choice([179.9995, -179.9995, 180.0])) for k in range(12)] + [(f"n{k}", 89.9999, rng.random() * 360 - 180) for k in range(8)]
    pts += pts[:20] + [(None, 46.0, 7.0), ("x", None, 7.0), ("y", float("nan"), 7.0), ("z", 0.0, 0.0), ("p1", 46.01, 7.01), ("q", 46.0, None), ("o", 95.0, 400.0)]
    assert run(spark, pts, 150.0) == brute(pts, 150.0)


def test_empty_and_one_place(spark):
    assert run(spark, [], 150.0) == set()
    pts = [(f"p{k:03}", 46.0, 7.0) for k in range(40)]
    assert len(run(spark, pts, 150.0)) == 40 * 39 // 2


def test_splits_cover_every_point():
    rng = np.random.default_rng(3)
    xyz = rng.normal(size=(5000, 3))
    nodes = P.fit_splits(xyz[:500], 20)
    at, leaf, home = P.descend(xyz, nodes, 0.05)
    assert np.array_equal(np.sort(at[home]), np.arange(len(xyz)))
    d = ((xyz[:200, None] - xyz[None, :200]) ** 2).sum(-1) ** 0.5
    homes = dict(zip(at[home], leaf[home]))
    seen = set(zip(at, leaf))
    assert all((j, homes[i]) in seen for i, j in zip(*np.nonzero(d <= 0.05)))


def test_regions(spark):
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    dent = [(0.0, 2.0), (0.0, 4.0), (1.0, 4.0), (0.2, 3.0), (1.0, 2.0)]
    rings = spark.createDataFrame([("s", [{"lat": a, "lon": b} for a, b in square]), ("d", [{"lat": a, "lon": b} for a, b in dent]), ("line", [{"lat": 0.0, "lon": 0.0}]), ("none", None)], "r string, ring array<struct<lat: double, lon: double>>")
    pts = spark.createDataFrame([("a", 0.5, 0.5), ("b", 0.9, 3.0), ("c", 0.1, 3.0), ("e", 5.0, 0.5), ("f", None, 0.5), (None, 0.5, 0.5)], "id string, lat double, lon double")
    got = {tuple(r) for r in P.points_in_regions(pts, "id", "lat", "lon", rings, "r", "ring").collect()}
    assert got == {("a", "s"), ("c", "d")}


def test_large_regions(spark):
    rng = random.Random(5)
    boxes = [(f"b{k}", a, a + h, b, b + w) for k, (a, b, h, w) in enumerate((rng.uniform(-60, 20), rng.uniform(-170, 20), 10 ** rng.uniform(-2, 1.7), 10 ** rng.uniform(-2, 2.1)) for _ in range(30))]
    boxes += [("east", -16.1, -15.9, 179.9, 180.2), ("east", -16.1, -15.9, -180.1, -179.8), ("globe", -80.0, 80.0, -180.0, 180.0)]
    rings = spark.createDataFrame([(k, [{"lat": a, "lon": b} for a, b in ((s, w), (s, e), (n, e), (n, w))]) for k, s, n, w, e in boxes], "r string, ring array<struct<lat: double, lon: double>>")
    pts = [(f"p{k}", rng.uniform(-70, 70), rng.uniform(-180, 180)) for k in range(400)] + [("m", -16.0, 180.0), ("n", -16.0, -180.0), ("o", -16.0, -179.8), ("q", -16.0, 179.9)]
    got = [tuple(r) for r in P.points_in_regions(spark.createDataFrame(pts, "id string, lat double, lon double"), "id", "lat", "lon", rings, "r", "ring").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, k) for i, a, b in pts for k, s, n, w, e in boxes if s <= a < n and w <= b < e}


def test_regions_of_wide_areas(spark, tmp_path):
    asked = [("wide", -16.0, 6.0), ("wide", 46.0, 179.0), ("line", -16.0, 179.9), ("line", -16.2, -179.9), ("three", -17.0, -179.5), ("three", 46.0, 6.0), ("three", 45.0, 179.5), ("small", 46.0, 6.0), ("small", 46.5, 6.5)]
    spark.createDataFrame(asked, "area_id string, lat double, lon double").write.parquet(f"{tmp_path}/requests.parquet")
    stops = [("a", 46.2, 6.2), ("b", 0.0, 90.0), ("c", -16.1, 179.95), ("d", -16.1, -179.95), ("e", -16.1, 180.0), ("f", -16.1, 0.0), ("g", -16.1, -179.9), ("h", -16.1, 179.9), ("i", 0.0, -100.0)]
    spark.createDataFrame(stops, "id string, lat double, lon double").write.parquet(f"{tmp_path}/stops.parquet")
    got = {tuple(r) for r in p5_region(spark, str(tmp_path)).collect()}
    line, three = {(k, "line") for k in "cdeh"}, {(k, "three") for k in "bcdegh"}
    assert got == {("a", "small"), ("b", "wide")} | line | three
