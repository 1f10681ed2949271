import heapq
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from footmesh.functions import codec, scalars
from footmesh.operators import graph as G
from footmesh.operators import hull as H
from footmesh.plans import walking
from footmesh.sources import network as N


def network(spark, nodes, ways, area="a"):
    """nodes: (id, lat, lon); ways: (id, [node ids], tags)."""
    elements = [{"type": "node", "id": i, "lat": la, "lon": lo} for i, la, lo in nodes] + [{"type": "way", "id": i, "nodes": ns, "tags": t} for i, ns, t in ways]
    body = json.dumps({"batch": {"area_id": area}, "attempts": [{"response": {"elements": elements}}]})
    df = spark.createDataFrame([(1, "2025", body)], "record_id bigint, received_at string, body string")
    points, lines = N.load_network(df)
    graph = G.graph_nodes(lines, points)
    return graph, G.way_edges(lines, graph)


def origins(spark, rows):
    return spark.createDataFrame([("a", k, la, lo) for k, la, lo in rows], "area_id string, origin string, lat double, lon double")


def lattice(n, step=0.001):
    nodes = [(r * n + c + 1, 49 + r * step, 8 + c * step) for r in range(n) for c in range(n)]
    ways = [(1000 + r, [r * n + c + 1 for c in range(n)], {"highway": "footway"}) for r in range(n)] + [(2000 + c, [r * n + c + 1 for r in range(n)], {"highway": "footway"}) for c in range(n)]
    return nodes, ways


def dijkstra(edges, starts, most):
    near = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    best, todo = {}, [(d, k) for k, d in starts.items() if d <= most]
    heapq.heapify(todo)
    while todo:
        d, k = heapq.heappop(todo)
        if k in best:
            continue
        best[k] = d
        for m, w in near.get(k, ()):
            if d + w <= most and m not in best:
                heapq.heappush(todo, (d + w, m))
    return best


def test_line_projection(spark):
    graph, edges = network(spark, [(1, 49, 8), (2, 49, 8.002)], [(10, [1, 2], {"highway": "footway"})])
    got = G.seeds(origins(spark, [("o", 49.0, 8.001), ("far", 49.1, 8.0)]), graph, edges, G.components(graph, edges)).collect()
    assert len(got) == 2 and {r.origin for r in got} == {"o"} and all(70 < r.d0 < 80 for r in got)


def test_crossing_shortens(spark):
    nodes = [(1, 49.00008, 8.0), (2, 49.00008, 8.001), (3, 48.99992, 8.0), (4, 48.99992, 8.001), (5, 49.0, 7.999), (6, 49.0, 8.002)]
    ways = [(10, [1, 2], {"highway": "footway"}), (11, [3, 4], {"highway": "footway"}), (12, [5, 6], {"highway": "residential"})]
    graph, edges = network(spark, nodes, ways)
    start = spark.createDataFrame([("a", "o", 1, 0.0)], "area_id string, origin string, id bigint, d0 double")
    budget = spark.createDataFrame([("a", "o", 100.0)], "area_id string, origin string, max_m double")
    plain = {r.id: r.d for r in G.shortest_paths(start, edges, budget).collect()}
    crossed = {r.id: r.d for r in G.shortest_paths(start, G.with_crossings(graph, edges), budget).collect()}
    assert 3 not in plain and crossed[3] < 30


def test_no_parallel_crossing(spark):
    graph, edges = network(spark, [(1, 49, 8), (2, 49, 8.00028), (3, 48.9999, 8.00014), (4, 49.0001, 8.00014)], [(10, [1, 2], {"highway": "footway"}), (11, [3, 4], {"highway": "residential"})])
    every = G.with_crossings(graph, edges)
    assert every.count() == every.select("u", "v").distinct().count()


@pytest.mark.parametrize("turned", [False, True])
def test_mirrored_tie(spark, turned):
    west, east = 7.99993896484375, 8.00006103515625
    ways = [(10, [1, 2], {"highway": "footway"}), (11, [3, 4], {"highway": "footway"})]
    if turned:
        ways = [(i, ns[::-1], t) for i, ns, t in ways[::-1]]
    graph, edges = network(spark, [(1, 49, west), (2, 49.00390625, west), (3, 49, east), (4, 49.00390625, east)], ways)
    got = G.nearest_edges(origins(spark, [("o", 49.001953125, 8.0)]), edges, G.area_scale(graph), 250.0).first()
    assert {got.u, got.v} == {1, 2}


def test_stub_is_bridged(spark):
    chain = [(k + 1, 49.0, 8 + k * 0.0002) for k in range(31)]
    nodes = [*chain, (100, 49.00028, 8.003), (101, 49.00028, 8.00305)]
    graph, edges = network(spark, nodes, [(1000, [k for k, _, _ in chain], {"highway": "footway"}), (1001, [100, 101], {"highway": "footway"})])
    comp = G.components(graph, edges)
    assert G.component_sizes(comp).agg(F.max("size")).first()[0] == 31
    ids = {r.id for r in G.seeds(origins(spark, [("o", 49.00029, 8.003)]), graph, edges, comp).collect()}
    assert ids & {k for k, _, _ in chain} and ids & {100, 101}


def test_budget_is_inclusive_and_exact(spark):
    nodes, ways = lattice(6)
    graph, edges = network(spark, nodes, ways)
    plain = [(r.u, r.v, r.w) for r in edges.collect()]
    start = spark.createDataFrame([("a", "o", 15, 0.0), ("a", "p", 1, 10.0), ("a", "p", 36, 130.0), ("a", "q", 1, 900.0)], "area_id string, origin string, id bigint, d0 double")
    budget = spark.createDataFrame([("a", "o", 300.0), ("a", "p", 250.0), ("a", "q", 800.0)], "area_id string, origin string, max_m double")
    got = {(r.origin, r.id): r.d for r in G.shortest_paths(start, edges, budget).collect()}
    want = {("o", k): d for k, d in dijkstra(plain, {15: 0.0}, 300).items()} | {("p", k): d for k, d in dijkstra(plain, {1: 10.0, 36: 130.0}, 250).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    places = origins(spark, [("o", 49.002, 8.002), ("p", 49.0, 8.0), ("q", 49.0, 8.0)])
    assert {(r.origin, r.id): r.d for r in G.batched_paths(start, edges, budget, places).collect()} == got


def test_batches_pass_the_date_line(spark):
    graph, edges = network(spark, [(1, -16.0, 179.9995), (2, -16.0, 180.0), (3, -16.0, -179.9995)], [(1, [1, 2], {"highway": "footway"}), (2, [2, 3], {"highway": "footway"})])
    start = spark.createDataFrame([("a", "o", 1, 0.0)], "area_id string, origin string, id bigint, d0 double")
    budget = spark.createDataFrame([("a", "o", 200.0)], "area_id string, origin string, max_m double")
    rounds = {r.id: r.d for r in G.shortest_paths(start, edges, budget).collect()}
    assert len(rounds) == 3 and {r.id: r.d for r in G.batched_paths(start, edges, budget, origins(spark, [("o", -16.0, 179.9995)])).collect()} == rounds


def test_missing_nodes_break_ways(spark):
    graph, edges = network(spark, [(1, 49, 8), (3, 49, 8.001), (4, 49, 8.002)], [(10, [1, 2, 3, None, 4, 4, 3], {"highway": "footway"})])
    assert {(r.u, r.v) for r in edges.collect()} == {(3, 4)}
    assert {r.id: r.node_idx for r in G.node_index(graph).collect()} == {1: 0, 3: 1, 4: 2}


def test_first_way_tells_road(spark):
    ways = [(1, [1, 2], {"highway": "footway"}), (2, [2, 1], {"highway": "residential"}), (3, [2, 3], [{"k": "highway", "v": "residential"}]), (4, [1, 3], {"highway": "motorway"}), (5, [1, 3], {"highway": "path", "access": "unknown"})]
    _, edges = network(spark, [(1, 49, 8), (2, 49, 8.001), (3, 49, 8.002)], ways)
    assert {(r.u, r.v, r.is_road) for r in edges.collect()} == {(1, 2, False), (2, 3, True)}


def test_empty_network(spark):
    graph, edges = network(spark, [], [])
    assert edges.count() == 0 and G.components(graph, edges).count() == 0


def test_hulls():
    rng = np.random.default_rng(0)
    for _ in range(30):
        pts = np.round(rng.normal(size=(60, 2)) * 50, 2)
        ring = H.concave_ring(pts)
        again = H.concave_ring(pts[rng.permutation(len(pts))])
        assert np.array_equal(ring, again)
        have = {tuple(p) for p in pts}
        assert all(tuple(p) in have for p in ring)
        area = lambda r: abs(np.dot(r[:, 0], np.roll(r[:, 1], -1)) - np.dot(r[:, 1], np.roll(r[:, 0], -1))) / 2
        assert area(ring) <= area(H.convex_ring(pts)) + 1e-9
        a, b = ring, np.roll(ring, -1, axis=0)
        for k in range(len(ring)):
            others = np.array([j for j in range(len(ring)) if j not in (k, (k + 1) % len(ring), (k - 1) % len(ring))])
            assert not H.crosses(a[k], b[k], a[others], b[others])
    assert len(H.concave_ring(np.array([[0, 0], [1, 1], [2, 2.0]]))) == 0


def test_hull_frames(spark):
    df = spark.createDataFrame([("r", 49.0, 8.0, float(x), float(y)) for x in range(4) for y in range(4)] + [("s", 49.0, 8.0, 0.0, 0.0)] * 5, "request_id string, c_lat double, c_lon double, x double, y double")
    assert {r.request_id for r in H.hulls(df).collect()} == {"r"}
    assert H.hulls(df, concave=False).count() == 4


def test_codec(spark):
    ring = [(49.009412, 8.404321), (49.010877, 8.406654), (49.008003, 8.407991), (49.006512, 8.403118)]
    df = spark.createDataFrame([([{"lat": a, "lon": b} for a, b in ring],), ([{"lat": 49.0, "lon": 8.0}, {"lat": 49.00002, "lon": 8.00003}],), ([],)], "p array<struct<lat: double, lon: double>>")
    rows = df.select("p", codec.encode(F.col("p")).alias("e")).select("*", codec.decode(F.col("e")).alias("d"), codec.valid_encoding(F.col("e")).alias("ok")).collect()
    assert all(abs(a - q.lat) <= 1e-5 and abs(b - q.lon) <= 1e-5 for (a, b), q in zip(ring, rows[0].d))
    assert rows[1].e == [4900000, 800000, 2, 3] and rows[2].e == []
    assert [r.ok for r in rows] == [True, False, False]


def test_scalars(spark):
    values = [("1", 100), ("124", 100), ("126", 150), ("2000", 2000), ("9999", 2000), ("", 777), ("abc", 777), (None, 777), ("NaN", 777), ("Infinity", 777), (" 300 ", 300), ("1e2", 100), ("-7", 100), ("1d", 777)]
    df = spark.createDataFrame([(v,) for v, _ in values], "v string")
    assert [r[0] for r in df.select(scalars.clamp_radius(F.col("v"), F.lit(777.0))).collect()] == [float(w) for _, w in values]
    df = spark.createDataFrame([(x,) for x in (46.3939265, 46.5245135, -0.5, 0.0, 179.9999999, 49.0)], "x double")
    assert [r[0] for r in df.select(codec.to_fixed(F.col("x"), 6)).collect()] == ["46.393926", "46.524513", "-0.500000", "0.000000", "180.000000", "49.000000"]
    df = spark.createDataFrame([("120",), ("Wed, 01 Jan 2025 00:00:10 GMT",), ("Wed, 01 Jan 2020 00:00:00 GMT",), ("soon",), (None,)], "v string")
    assert [r[0] for r in df.select(scalars.retry_after_ms(F.col("v"), F.lit(1735689600000.0))).collect()] == [120_000.0, 10_000.0, 0.0, None, None]
    ring = spark.range(1).select(scalars.circle(F.lit(49.0), F.lit(8.0), F.lit(300.0)).alias("r")).first().r
    assert len(ring) == 65 and math.isclose(ring[0].lon, ring[64].lon, abs_tol=1e-12)


def test_padding_by_bucket(spark):
    df = spark.createDataFrame([(250.0,), (300.0,), (301.0,), (6000.0,), (None,)], "r double")
    assert [r[0] for r in df.select(scalars.radius_bucket(F.col("r"))).collect()] == [300.0, 300.0, 600.0, 6000.0, None]


def test_every_request_has_a_result(spark, tmp_path):
    nodes, ways = lattice(6)
    elements = [{"type": "node", "id": i, "lat": la, "lon": lo} for i, la, lo in nodes] + [{"type": "way", "id": i, "nodes": ns, "tags": t} for i, ns, t in ways]
    body = json.dumps({"batch": {"area_id": "a"}, "attempts": [{"response": {"elements": elements}}]})
    spark.createDataFrame([(1, "2025", body)], "record_id bigint, received_at string, body string").write.parquet(f"{tmp_path}/network_responses.parquet")
    asked = [("ring", "a", 49.0021, 8.0021), ("ring", "a", 49.0021, 8.0021), ("far", "a", 50.0, 8.0), ("no net", "b", 49.0021, 8.0021), ("no area", None, 49.0021, 8.0021), ("no place", "a", None, 8.0021), ("no number", "a", 49.0021, float("nan"))]
    spark.createDataFrame([(*r, 300.0) for r in asked], "request_id string, area_id string, lat double, lon double, radius_m double").write.parquet(f"{tmp_path}/requests.parquet")
    got = walking.walk_polygons(spark, str(tmp_path)).collect()
    assert {r.request_id for r in got if r.reason is None} == {"ring"}
    assert sorted((r.request_id, r.reason) for r in got if r.reason) == [(k, "no-nearby-edge") for k in ("far", "no area", "no net", "no number", "no place")]


def test_segment_cells_around_the_globe(spark, tmp_path):
    elements = [{"type": "node", "id": i, "lat": la, "lon": lo} for i, la, lo in [(1, -16.0, 179.999), (2, -16.001, -179.999), (3, -16.0, 179.99)]] + [{"type": "way", "id": 9, "nodes": [3, 1, 2], "tags": {"highway": "footway"}}]
    body = json.dumps({"batch": {"area_id": "a"}, "attempts": [{"response": {"elements": elements}}]})
    spark.createDataFrame([(1, "2025", body)], "record_id bigint, received_at string, body string").write.parquet(f"{tmp_path}/network_responses.parquet")
    size, scale = 250 / 111320, math.cos(math.radians(-16.0))
    at = lambda x: math.floor(x / size)
    want = {(1, 2, y, x) for y in range(at(-16.001), at(-16.0) + 1) for x in range(at(-179.999 * scale), at(179.999 * scale) + 1)} | {(1, 3, at(-16.0), x) for x in range(at(179.99 * scale), at(179.999 * scale) + 1)}
    got = walking.graph_segment_cells(spark, str(tmp_path)).select("u", "v", "cell_y", "cell_x").toPandas()
    assert len(got) == len(want) > 150_000 and set(got.itertuples(index=False, name=None)) == want
