import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from footmesh.functions import codec, policy
from footmesh.operators import build, etl, folds, hull, serving, viewport
from footmesh.plans import serving as plans
from footmesh.sources import datasets, guards


def test_classification(spark):
    tags = [{"railway": "tram_stop"}, {"railway": "halt", "bus": "yes"}, {"highway": "bus_stop"}, {"amenity": "bus_station"}, {"public_transport": "station", "light_rail": "yes"}, {"public_transport": "station", "train": "yes", "tram": "yes"}, {"public_transport": "station"}, {"public_transport": "platform", "tram": "yes"}, {}, None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(tags)], "k int, tags map<string,string>")
    got = [(r.a, r.b) for r in df.select("k", etl.classify(F.col("tags")).alias("a"), etl.legacy_tagged(F.col("tags")).alias("b")).orderBy("k").collect()]
    assert got == [("tram", True), ("train", True), ("bus", True), ("bus", True), ("tram", False), ("train", False), (None, False), (None, False), (None, False), (None, False)]


def test_register_from_nodes(spark, tmp_path):
    stop, newer = {"railway": "tram_stop", "name": "A"}, {"public_transport": "station", "tram": "yes", "name": "A"}
    rows = [(1, 49.0, 8.0, stop), (2, 49.001, 8.0, newer), (3, 49.01, 8.0, newer), (4, 49.0, 8.0, {"highway": "bus_stop"}), (4, 49.0, 8.0, {"highway": "bus_stop"}), (5, float("inf"), 8.0, stop), (None, 49.0, 8.0, stop), (6, 60.0, 8.0, stop), (7, 49.0, 8.0, None)]
    df = spark.createDataFrame(rows, "id bigint, lat double, lon double, tags map<string,string>")
    got = etl.stops_from_nodes(df, (48.0, 7.0, 50.0, 9.0))
    assert {(r.id, r.name, r.type) for r in got.collect()} == {("osm-1", "A", "tram"), ("osm-3", "A", "tram"), ("osm-4", etl.UNNAMED, "bus")}
    etl.write_register(got, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3
    assert etl.stops_from_nodes(df.limit(0)).count() == 0


def test_german_order_is_dense(spark):
    names = ["Öl", "Ofen", "Zebra", "ä", "Az", "a", "a", "ß", "ss"]
    df = spark.createDataFrame([(str(k), n, 0.0, 0.0, "bus") for k, n in enumerate(names)], "id string, name string, lat double, lon double, type string")
    rows = sorted(etl.german_order(df, 3).collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == list(range(9)) and [r.name for r in rows] == ["a", "a", "ä", "Az", "Ofen", "Öl", "ss", "ß", "Zebra"]


def test_last_before_against_brute_force(spark):
    rng, t = random.Random(5), datetime(2025, 1, 1)
    at = lambda: t + timedelta(hours=rng.randrange(200))
    key = lambda: rng.choice(["hot", "hot", "b", None])
    probes, entries = [(k, key(), at()) for k in range(60)], [(key(), at(), rng.randrange(9)) for _ in range(60)]
    p = spark.createDataFrame(probes, "id int, key string, at timestamp_ntz")
    e = spark.createDataFrame(entries, "key string, seen timestamp_ntz, v int")
    got = {r.id: (r.found_seen, r.found_v) for r in serving.last_before(p, e, "key", "at", "seen", ["seen", "v"], F.to_date("t")).collect()}
    assert got == {i: max(((s, v) for q, s, v in entries if q == k and k is not None and s <= a), default=(None, None)) for i, k, a in probes}


def test_answers_in_order(spark):
    rows = [(1, True, True, True, None, False), (2, False, True, True, None, False), (3, False, True, True, None, True), (4, False, False, True, 9, True), (5, False, False, False, 9, True), (6, False, False, False, 5, True), (7, False, False, False, None, True)]
    df = spark.createDataFrame(rows, "id int, memory boolean, persisted boolean, shipped boolean, retry_at int, current boolean").withColumn("at", F.lit(5))
    assert [r.answer for r in serving.answer(df).orderBy("id").collect()] == ["memory", "superseded", "persisted", "shipped", "cached-unavailable", "pending", "pending"]


def test_settling(spark):
    pending = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 1, 2), ("d", 1, 1)], "key string, version int, current_version int")
    results = spark.createDataFrame([("a", "polygon", None), ("b", "polygon", None), ("c", "unavailable", "no-data")], "key string, status string, reason string")
    got = {r.key: (r.status, r.reason, r.stored) for r in serving.settle(pending, results, "key").collect()}
    assert got == {"a": ("polygon", None, True), "b": ("superseded", None, False), "c": ("unavailable", "no-data", False), "d": ("superseded", None, False)}


def test_invalidation_by_prefix(spark):
    keys = spark.createDataFrame([("s:1:v2:x",), ("s:v2:x",), ("s2:v2",), ("other",), ("",), (None,)], "key string")
    ids = spark.createDataFrame([(" s ",), ("",), (None,), ("nobody",)], "id string")
    kept, gone = serving.invalidate(keys, ids)
    assert {r.key for r in gone.collect()} == {"s:1:v2:x", "s:v2:x"} and kept.count() == 4
    assert serving.removed_keys(keys, kept).count() == 2


def test_times_and_markers(spark):
    df = spark.createDataFrame([("5", 10), ("10", 10), ("12", 10), ("x", 10), (None, 10)], "m string, now bigint")
    assert [r[0] for r in df.select(serving.next_marker(F.col("m"), F.col("now"))).collect()] == [10, 11, 13, 10, 10]
    waits = spark.createDataFrame([(0.0,), (1500.5,), (-3.0,), (None,)], "w double")
    assert [r[0] for r in waits.select(serving.bounded_wait_ms(F.col("w"))).collect()] == [1000, 1501, 1000, None]
    ids = spark.createDataFrame([([" b", "a", None, "", "a "],)], "ids array<string>")
    assert ids.select(serving.normal_ids(F.col("ids"))).first()[0] == ["a", "b"]


def test_entries_are_guarded(spark):
    square = [(49.0, 8.0), (49.0, 8.1), (49.1, 8.1)]
    rows = [("k", "polygon", square, None, 1), ("k", "polygon", square[:2] + square[:1], None, 1), ("k", "polygon", [(91.0, 8.0), *square], None, 1), ("", "polygon", square, None, 1), ("k", "polygon", None, None, 1), ("k", "unavailable", None, 5, 1), ("k", "unavailable", None, None, 1), ("k", "other", square, 5, 1), ("k", "polygon", square, None, None), ("k", "polygon", [(float("nan"), 8.0), *square], None, 1)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "no int, key string, kind string, polygon array<struct<lat: double, lon: double>>, retry_at int, updated_at int")
    assert [r[1] for r in df.select("no", serving.valid_entry()).orderBy("no").collect()] == [True, False, False, False, False, True, False, False, False, False]


def test_preload(spark):
    have = spark.createDataFrame([("bus", 200.0, True), ("tram", 300.0, False)], "type string, radius_m double, valid boolean")
    want = lambda *r: serving.preloaded(spark.createDataFrame(r, "type string, radius_m double"), have).first().ready
    assert want(("bus", 200.0)) and not want(("bus", 200.0), ("tram", 300.0)) and not want(("train", 400.0)) and not want()


def test_upserts(spark):
    a = spark.createDataFrame([("x", "polygon", 1), ("y", "polygon", 1), ("z", "polygon", 1)], "key string, kind string, at int")
    b = spark.createDataFrame([("x", "unavailable", 2), ("x", "polygon", 3), ("y", None, 2), ("new", "polygon", 2), (None, "polygon", 9)], "key string, kind string, at int")
    assert {tuple(r) for r in datasets.upserted(a, b, "key", "at").collect()} == {("x", "polygon", 3), ("z", "polygon", 1), ("new", "polygon", 2)}
    assert datasets.upserted(a, b.limit(0), "key", "at").count() == 3


def payload(spark, *elements):
    df = spark.createDataFrame([(json.dumps(e),) for e in elements], "t string").withColumn("response", F.parse_json("t"))
    return [r.valid for r in guards.payloads(df).select("valid").collect()]


def test_payloads_pass_as_a_whole(spark):
    node, way = {"type": "node", "id": 1, "lat": 1.5, "lon": 2}, {"type": "way", "id": 2, "nodes": [1, 2], "tags": {"highway": "path"}}
    bad = [{**way, "nodes": ["invalid"]}, {**node, "id": "1"}, {**node, "lat": None}, {**way, "nodes": 5}, {**way, "tags": {"a": 1}}, {**way, "tags": None}, {"type": "relation", "id": 1}, 7]
    good = [[], [node, way], [{**way, "nodes": []}], [{k: v for k, v in way.items() if k != "tags"}], [{**way, "tags": {}}]]
    assert payload(spark, *({"elements": g} for g in good)) == [True] * len(good)
    assert payload(spark, *({"elements": [node, b]} for b in bad)) == [False] * len(bad)
    assert payload(spark, {}, {"elements": None}, {"elements": {"0": node}}, 5) == [False] * 4


def test_dataset_files(spark):
    good = {"version": 1, "generatedAt": "2025-01-01T00:00:00.000Z", "precision": 100000, "allowReasonableStreetCrossings": True, "radiusByType": {"train": 400, "tram": 300, "bus": 200}, "polygons": {"osm-1:tram:49:8": [4900000, 800000, 2, 3, -1, 5]}}
    bad = [{**good, "version": 999}, {**good, "polygons": {"k": [1, 2, 3]}}, {**good, "precision": 0}, {**good, "precision": 1.5}, {**good, "generatedAt": "soon"}, {**good, "allowReasonableStreetCrossings": "yes"}, {**good, "radiusByType": {"train": 400, "tram": 300}}, {**good, "polygons": {"k": [9100000, 0, 1, 1, 1, 1]}}, {**good, "polygons": {"k": [1.5, 0, 1, 1, 1, 1]}}, [good]]
    df = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate([good, {**good, "polygons": {}}, *bad])] + [(99, "no json"), (100, None)], "no int, text string")
    got = {r.no: r for r in guards.parse_datasets(df).collect()}
    assert got[0].valid and got[1].valid and not any(r.valid for k, r in got.items() if k > 1)
    assert [(p.polygon_key, p.encoded) for p in got[0].polygons] == [("osm-1:tram:49:8", [4900000, 800000, 2, 3, -1, 5])] and got[2].polygons is None


def test_retry_policy():
    def run(replies, **kw):
        replies, waits = iter(replies), []
        out = policy.fetch(["a", "b"], lambda e: next(replies), waits.append, **kw)
        return out[0], [(x.endpoint, x.outcome) for x in out[1]], waits

    R, bad = policy.Reply, "retryable-failure"
    assert run([R("net")]) == ("net", [("a", "ok")], [])
    assert run([R(status=400)]) == (None, [("a", "fatal-failure")], [])
    assert run([R(status=503), R("net")]) == ("net", [("a", bad), ("b", "ok")], [])
    assert run([R(status=429, retry_after_ms=7000), R(), R("net")], jitter=lambda: 0.5) == ("net", [("a", bad), ("b", bad), ("a", "ok")], [7250])
    assert run([R()] * 4) == (None, [("a", bad), ("b", bad)] * 2, [1000])


def test_endpoint_order(spark):
    stats = spark.createDataFrame([("a", 800, 0), ("b", 800, 0), ("c", 100, 1)], "endpoint string, latency_ms bigint, failure_streak bigint")
    order = lambda **kw: [r.endpoint for r in folds.endpoint_ranks(stats, **kw).orderBy("rank").collect()]
    assert order() == ["a", "b", "c"]
    assert order(preferred=spark.createDataFrame([("b",)], "endpoint string")) == ["b", "a", "c"]
    assert order(ordinals=spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "endpoint string, ordinal int")) == ["b", "a", "c"]


def test_build_options():
    parse = lambda *a: build.parse_options(a, "out")
    assert parse() == build.BuildOptions("out") and parse("--types", "bus,tram, bus").types == ("tram", "bus")
    assert parse("--types", "bus", "--radius", "250").radii["bus"] == (250,) and parse("--limit", "0").limit == 0 and parse("--concurrency", "4", "--out-dir", "x").concurrency == 4
    for bad in (["--radius", "250"], ["--types", "bus", "--radius", "275"], ["--types", "ship"], ["--types", ""], ["--limit", "-1"], ["--limit", "x"], ["--concurrency", "0"], ["--limit"], ["--limit", "--types"], ["limit", "3"], ["--what", "3"], ["--radius", "0"]):
        with pytest.raises(ValueError):
            parse(*bad)


def test_retry_passes():
    tries, rests = [], []

    def compute(b):
        tries.append(b)
        return tries.count(b) >= b

    assert build.run_passes([1, 2, 3, 9], compute, rest=rests.append) == ([9], 3) and rests == [3, 6]
    assert build.run_passes([], compute) == ([], 0)


def test_shards_and_texts(spark):
    counts = spark.createDataFrame([("bus", 5), ("train", 5)], "type string, stops bigint")
    assert json.loads(build.shard_json(counts)) == {"include": [{"type": "train"}, {"type": "bus"}, {"type": "tram"}]}
    assert [r.type for r in build.shards(counts.limit(0)).orderBy("pos").collect()] == ["tram", "train", "bus"]
    row = spark.range(1).select(build.average_ms(F.lit(5), F.lit(2)), build.average_ms(F.lit(5), F.lit(0)), build.mebibytes(F.lit(1_572_864)), build.seconds(F.lit(1250))).first()
    assert row[0] == 3 and row[1] == 0 and row[2] == "1.50" and row[3] in ("1.2s", "1.3s")
    assert build.radius_summary({"bus": 200, "tram": 300.0}) == "200–300 m" and build.radius_summary({"bus": 200}) == "200 m"
    assert "- Passes: 2" in build.step_summary({"types": ("bus",), "passes": 2, "error": "x"})


def test_traversals_share_seeds(spark):
    seeds = spark.createDataFrame([("a", "o", 4, 0.0), ("a", "o", 8, 130.0)], "area_id string, origin string, id bigint, d0 double")
    asked = spark.createDataFrame([("a", "o", r) for r in (100.0, 200.0, 250.0, 250.0, 0.5)], "area_id string, origin string, radius_m double")
    got = {(r.max_m, tuple(r.radii), r.n_seeds) for r in build.traversals(seeds, asked).collect()}
    assert got == {(100.0, (100.0,), 1), (250.0, (200.0, 250.0), 2)}
    assert {r.max_m for r in build.traversals(seeds.where("id = 4"), asked).collect()} == {250.0}


def batches(points, radius=200.0, priority=()):
    lat, lon = (np.array(x) for x in zip(*points))
    got = viewport.form_batches(lat, lon, np.full(len(lat), radius), np.isin(np.arange(len(lat)), priority), (49.0, 8.0))
    return sorted(np.bincount(got).tolist()), got


def test_greedy_batches():
    near = [(49.0, 8.0), (49.001, 8.001), (49.002, 8.0)]
    assert batches(near)[0] == [3] and batches([*near, (49.02, 8.0)])[0] == [1, 3]
    assert batches([(49.0, 8.0), (49.01, 8.014), (48.99, 7.986)])[0] == [1, 2]
    assert batches([(49 + 0.0015 * r, 8 + 0.0015 * c) for r in range(7) for c in range(7)])[0] == [1, 48]
    sizes, got = batches([*near, (49.02, 8.0)], priority=[3])
    assert got[3] == 0


def test_greedy_batches_by_view(spark):
    q = spark.createDataFrame([("v", f"s{k}", 49.0 + k * 0.0001, 8.0, 200.0, False) for k in range(60)] + [("w", "s1", 49.0, 8.0, 200.0, False), ("w", "s1", 49.0, 8.0, 200.0, False)], "view_id string, id string, lat double, lon double, radius_m double, priority boolean")
    v = spark.createDataFrame([("v", 49.0, 8.0), ("w", 49.0, 8.0)], "view_id string, c_lat double, c_lon double")
    got = viewport.greedy_batches(q, v).groupBy("view_id", "batch_no").count().collect()
    assert sorted((r.view_id, r["count"]) for r in got) == [("v", 12), ("v", 48), ("w", 1)]
    assert viewport.greedy_batches(q.limit(0), v).count() == 0


def area(ring):
    x, y = ring[:, 0], ring[:, 1]
    return abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=60), st.randoms())
def test_concave_ring(points, rng):
    pts = np.array(points, float)
    ring, outer = hull.concave_ring(pts), hull.convex_ring(np.unique(pts, axis=0))
    if len(outer) < 3:
        assert len(ring) == 0
        return
    have = set(map(tuple, pts.tolist()))
    assert len(ring) >= len(outer) and {tuple(p) for p in ring.tolist()} <= have and {tuple(p) for p in outer.tolist()} <= {tuple(p) for p in ring.tolist()}
    assert len({tuple(p) for p in ring.tolist()}) == len(ring) and area(ring) <= area(outer) + 1e-9
    mixed = points[:]
    rng.shuffle(mixed)
    assert np.array_equal(hull.concave_ring(np.array(mixed, float)), ring)


def test_concave_ring_digs():
    # a long side with one point near it and near enough to one end
    got = hull.concave_ring(np.array([(0, 0), (100, 0), (100, 100), (0, 100), (30, 20)], float))
    assert [30.0, 20.0] in got.tolist() and area(got) == 10_000 - 1_000
    # the nearest candidate is too far from both ends: nothing else is tried
    assert len(hull.concave_ring(np.array([(0, 0), (100, 0), (100, 100), (0, 100), (50, 1), (20, 20)], float))) == 4


def test_codec(spark):
    ring = [(49.0, 8.0), (49.00002, 8.00003)]
    df = spark.createDataFrame([(ring,), ([],)], "p array<struct<lat: double, lon: double>>")
    assert [r[0] for r in df.select(codec.encode(F.col("p"))).collect()] == [[4900000, 800000, 2, 3], []]
    long = [(49 + k * 1e-5, 8 - k * 2e-5) for k in range(3001)]
    row = spark.createDataFrame([(long,)], df.schema).select(codec.decode(codec.encode(F.col("p"))).alias("d"), codec.valid_encoding(codec.encode(F.col("p"))).alias("v")).first()
    assert row.v and len(row.d) == 3001 and max(abs(a.lat - b[0]) + abs(a.lon - b[1]) for a, b in zip(row.d, long)) < 2e-5


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_empty_tables(spark, small, tmp_path, name):
    for table in ("stops", "requests", "network_responses"):
        spark.read.parquet(f"{small}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    got = entry.queries()[name](spark, str(tmp_path)).count()
    assert got == 0 or name in ("cache_size", "build_report", "build_shards", "build_outputs", "scalar_radius", "scalar_wait")
