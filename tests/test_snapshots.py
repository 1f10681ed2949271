from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from footmesh.operators import snapshots as S

SCHEMA = "snapshot_no int, id string, lat double, lon double, loaded_at timestamp, key string, ordinal string"
T0, T1 = datetime(2025, 1, 1), datetime(2025, 1, 2)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)  # columns with names the operator uses inside
    out = S.snapshot_changes(df, "snapshot_no", "id", "lat", "lon", "loaded_at")
    return sorted((r.key, r.snap_no, r.change_kind) for r in out.collect())


def test_kinds_and_dirt(spark):
    rows = [
        (1, "A", 46.0, 7.0, T0), (2, " a ", 46.0, 7.0, T0), (3, "a", 46.00002, 7.0, T0), (4, "a", 46.00002, None, T0), (4, "a", 46.00002, None, T0),
        (1, "b", 46.0, 7.0, T0), (3, "b", 46.0, 7.0, T0),
        (1, "c", 1.0, 1.0, T1), (1, "c", 9.0, 9.0, T0), (2, "c", 1.0, 1.0, T0), (2, "c", 9.0, 9.0, None),
        (1, "d", float("nan"), 1.0, T0), (2, "d", None, 1.0, T0),
        (1, None, 1.0, 1.0, T0), (2, "  ", 1.0, 1.0, T0), (None, "e", 1.0, 1.0, T0),
    ]
    assert run(spark, rows) == [("a", 3, "changed"), ("a", 4, "changed"), ("b", 2, "removed"), ("b", 3, "added"), ("b", 4, "removed"), ("c", 3, "removed"), ("d", 3, "removed")]


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "a", 1.0, 1.0, T0)]) == []


def test_missing_snapshot_is_empty(spark):
    assert run(spark, [(1, "a", 1.0, 1.0, T0), (3, "a", 1.0, 1.0, T0)]) == [("a", 2, "removed"), ("a", 3, "added")]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, (1 << 16) - 1), max_size=300), st.integers(0, 60_000), st.integers(0, 5_000))
def test_bitmaps_round_trip(some, start, length):
    low = np.array(sorted(some | set(range(start, min(start + length, 1 << 16)))), np.int64)
    packed = S.compress(low)
    assert np.array_equal(np.flatnonzero(S.decompress(packed)), low)
    assert len(packed) <= 1 + min(2 * len(low), 8192)


def test_ordinals_persist(spark):
    first = S.extend_ordinals(spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "key string"))
    known = {r.key: r.ordinal for r in first.collect()}
    assert sorted(known.values()) == [0, 1]
    both = {r.key: r.ordinal for r in S.extend_ordinals(spark.createDataFrame([("c",), ("a",)], "key string"), first).collect()}
    assert both == {**known, "c": 2}


def test_long_key_and_many_rows_of_one(spark):
    long = "k" * 100_000
    rows = [(1, long, 1.0, 1.0, T0)] * 50 + [(2, "x", 1.0, 1.0, T0)] * 50
    assert run(spark, rows) == [(long, 2, "removed"), ("x", 2, "added")]


@pytest.mark.parametrize("n", [0, 1, 65536])
def test_bitmap_extremes(n):
    low = np.arange(n)
    assert np.array_equal(np.flatnonzero(S.decompress(S.compress(low))), low)
