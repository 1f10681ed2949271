import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footmesh.operators import folds, stops
from footmesh.sources import datasets
from footmesh.streaming import bursts


def fold(events):
    latency, streak, good = None, 0, 0
    for x, ok in events:
        if ok:
            x = max(1, int(x + 0.5))
            latency = x if latency is None else int(latency * 0.75 + x * 0.25 + 0.5)
            streak, good = 0, good + 1
        else:
            streak = min(6, streak + 1)
    return (latency if latency is not None else 700, streak, good)


@pytest.mark.parametrize("segment", [7, 20_000])
def test_smoothed_latency(spark, monkeypatch, segment):
    monkeypatch.setattr(folds, "SEGMENT", segment)
    rng = random.Random(2)
    log = [("e%d" % rng.choice([0, 0, 0, 1, 2]), k, rng.randrange(1, 30_000), rng.random() < 0.7) for k in range(400)] + [("bad", k, 5, False) for k in range(9)] + [(None, 1, 1, True)]
    df = spark.createDataFrame(log, "endpoint string, no bigint, ms bigint, ok boolean")
    got = {r.endpoint: (r.latency_ms, r.failure_streak, r.successes) for r in folds.smoothed_latency(df, "endpoint", ["no"], "ms", F.col("ok")).collect()}
    assert got == {e: fold([(x, ok) for f, _, x, ok in sorted(log, key=lambda r: r[1]) if f == e]) for e in {r[0] for r in log} - {None}}


def test_lru(spark):
    def evicted(rows, entries, weight):
        df = spark.createDataFrame([("g", k, *r) for k, r in enumerate(rows)], "g string, no int, key string, w double")
        return [r.key for r in folds.weighted_lru(df, "g", ["no"], "key", "w", entries, weight).orderBy("evicted_at").collect()]

    assert evicted([("old", 1.0), ("kept", 1.0), ("old", 1.0), ("new", 1.0)], 2, 100) == ["kept"]
    assert evicted([("a", 8.0), ("a", 2.0), ("b", 8.0)], 3, 10) == []
    assert evicted([("old", 5.0), ("huge", 20.0)], 3, 10) == ["old"]
    assert evicted([], 3, 10) == []


def test_prune(spark, monkeypatch):
    monkeypatch.setattr(folds, "MAX_POLYGONS", 3)
    monkeypatch.setattr(folds, "MAX_UNAVAILABLE", 2)
    t = datetime(2025, 1, 31)
    rows = [("p%d" % k, "polygon", t - timedelta(days=k * 20)) for k in range(4)] + [("u%d" % k, "unavailable", t - timedelta(days=k)) for k in range(4)]
    df = spark.createDataFrame(rows, "key string, kind string, updated_at timestamp")
    assert {r.key for r in folds.prune_cache(df, F.lit(t)).collect()} == {"p0", "p1", "u0"}


def test_near_duplicates(spark):
    rows = [("a", "x", 49.0, 8.0, "bus", False), ("b", "x", 49.001, 8.0, "bus", True), ("c", "x", 49.002, 8.0, "bus", True), ("d", "y", 49.0, 8.0, "bus", True), ("e", "x", 49.0, 8.0019, "bus", True), ("f", "x", -80.0, 8.0, "bus", False), ("g", "x", -80.0, 8.007, "bus", True)]
    df = spark.createDataFrame(rows, "id string, name string, lat double, lon double, type string, second boolean")
    assert {r.id for r in stops.drop_near_duplicates(df, F.col("second")).collect()} == {"a", "c", "d", "f"}


def test_batches_hold_48(spark):
    df = spark.createDataFrame([(f"s{k:04}", 49.0, 8.0, "bus") for k in range(200)], "id string, lat double, lon double, type string")
    sizes = sorted(r["count"] for r in stops.stop_batches(df).groupBy("batch_no").count().collect())
    assert sizes == [8, 48, 48, 48, 48]


def test_datasets(spark, tmp_path):
    path = str(tmp_path / "sets")
    df = spark.createDataFrame([("bus", 200, "k1", [1, 2, 3, 4, 5, 6]), ("bus", 200, "empty", []), ("tram", 300, "k2", [1] * 8)], "type string, radius_m int, polygon_key string, encoded array<bigint>")
    datasets.write_datasets(df, path)
    datasets.write_datasets(df.where("type = 'bus'").withColumn("polygon_key", F.lit("k9")), path)
    assert {(r.type, r.polygon_key) for r in datasets.read_datasets(spark, path).collect()} == {("bus", "k9"), ("tram", "k2")}
    assert datasets.read_datasets(spark, path, "bus", 250).count() == 0


def test_streamed_bursts(spark, tmp_path):
    t = datetime(2025, 1, 1)
    rows = [("a", t + timedelta(seconds=s), 1.0) for s in (0, 60, 90, 600)] + [("b", t, None), ("a", t + timedelta(hours=5), 1.0)]
    df = spark.createDataFrame(rows, "area_id string, requested_at timestamp, radius_m double")
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    for make, want in ((bursts.request_bursts, {("a", 3), ("a", 1), ("b", 1)}), (lambda d: bursts.window_counts(d, late="1 minute").withColumnRenamed("requests", "n"), {("a", 4), ("b", 1)})):
        name = f"out_{len(want)}"
        query = make(spark.readStream.schema(df.schema).parquet(path)).writeStream.outputMode("append").format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
        assert want <= {(r.area_id, r.n) for r in spark.table(name).collect()}
