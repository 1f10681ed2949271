"""What changed between full snapshots (problem 1).

Keys are mapped to persistent dense ordinals. A snapshot is packed, by chunk of ordinals, into a
compressed bitmap of those present and the column vectors of its values, aligned to the bitmap.
Consecutive snapshots meet chunk by chunk: AND-NOT either way gives removals and additions, AND gives
the common keys, whose aligned vectors expose changes. Packed snapshots and the dictionary are plain
tables, so that a delivery costs one packing and one comparison with the stored state of the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footmesh.functions.geo import EARTH_RADIUS_M
from footmesh.runtime import cut, map_groups, stripped

CHUNK_BITS = 16
NUMBERING_BUCKETS = 512
PACKED = "snap_no int, chunk bigint, bitmap binary, vec_a binary, vec_b binary"


def normal_id(c: Column) -> Column:
    return F.lower(stripped(c))


def extend_ordinals(keys: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Give every distinct ``key`` a dense ordinal; ``known`` (key, ordinal) keeps its own, new keys follow.

    Numbering is spread over hash buckets: each bucket numbers its keys by a sort of its own, and the
    buckets' offsets come from their counts, of which there are NUMBERING_BUCKETS. Null keys get none.
    """
    new = keys.select("key").where(F.col("key").isNotNull()).distinct()
    start = F.lit(0).cast("bigint")
    if known is not None:
        new = new.join(known.select("key"), "key", "left_anti")
        start = F.lit(known.agg(F.coalesce(F.max("ordinal") + 1, F.lit(0))).first()[0]).cast("bigint")
    new = new.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(NUMBERING_BUCKETS)))
    # one row a bucket, so the window without partitions and the broadcast are bounded by NUMBERING_BUCKETS
    sizes = new.groupBy("bucket").agg(F.count("*").alias("n"))
    offsets = sizes.select("bucket", (F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).alias("before"))
    numbered = new.withColumn("rn", F.row_number().over(W.partitionBy("bucket").orderBy("key")))
    out = numbered.join(F.broadcast(offsets), "bucket").select("key", (start + F.coalesce("before", F.lit(0)) + F.col("rn") - 1).alias("ordinal"))
    return out if known is None else known.select("key", "ordinal").unionByName(out)


def compress(low: np.ndarray) -> bytes:
    """The shortest of three forms of a sorted set of 16-bit numbers: list, runs or bits; the first byte tells which."""
    low = low.astype(np.uint16)
    if not len(low):
        return b"L"
    breaks = np.flatnonzero(np.diff(low.astype(np.int32)) != 1)
    starts, ends = low[np.r_[0, breaks + 1]], low[np.r_[breaks, len(low) - 1]]
    size = min(2 * len(low), 4 * len(starts), (1 << CHUNK_BITS) // 8)
    if size == 4 * len(starts):
        return b"R" + np.stack([starts, ends], 1).astype("<u2").tobytes()
    if size == 2 * len(low):
        return b"L" + low.astype("<u2").tobytes()
    bits = np.zeros(1 << CHUNK_BITS, bool)
    bits[low] = True
    return b"B" + np.packbits(bits, bitorder="little").tobytes()


def decompress(data: bytes | None) -> np.ndarray:
    """A bool vector of the chunk; no bitmap is the empty set."""
    bits = np.zeros(1 << CHUNK_BITS, bool)
    if data is None:
        return bits
    kind, body = data[:1], bytes(data[1:])
    if kind == b"B":
        return np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little").astype(bool)
    if kind == b"L":
        bits[np.frombuffer(body, "<u2")] = True
        return bits
    edges = np.zeros((1 << CHUNK_BITS) + 1, np.int32)
    runs = np.frombuffer(body, "<u2").reshape(-1, 2).astype(np.int64)
    edges[runs[:, 0]] += 1
    edges[runs[:, 1] + 1] -= 1
    return np.cumsum(edges[:-1]) > 0


def pack_snapshots(rows: DataFrame) -> DataFrame:
    """``rows``: snap_no, ordinal, a, b; one row a snapshot and ordinal. NaN stands for null in the vectors."""

    def pack(key: tuple, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        low = (frame["ordinal"].to_numpy(np.int64) & ((1 << CHUNK_BITS) - 1)).astype(np.int64)
        a, b = (frame[c].to_numpy(np.float64, na_value=np.nan).astype("<f8").tobytes() for c in ("a", "b"))
        yield pd.DataFrame({"snap_no": [key[1]], "chunk": [key[0]], "bitmap": [compress(low)], "vec_a": [a], "vec_b": [b]})

    chunked = rows.withColumn("chunk", F.shiftright("ordinal", CHUNK_BITS))
    return map_groups(chunked, ["chunk", "snap_no"], pack, PACKED, ["ordinal"])


def haversine_np(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin((np.radians(lon2) - np.radians(lon1)) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(h))


def compare_packed(packed: DataFrame, nums: DataFrame, tolerance_m: float) -> DataFrame:
    """``nums``: snap_no of the later snapshot of each pair. Gives ordinal, snap_no, change_kind."""
    now = packed.join(F.broadcast(nums), "snap_no")
    before = packed.select((F.col("snap_no") + 1).alias("snap_no"), "chunk", *(F.col(c).alias(f"p_{c}") for c in ("bitmap", "vec_a", "vec_b")))
    before = before.join(F.broadcast(nums), "snap_no")
    both = now.join(before, ["snap_no", "chunk"], "full_outer")

    def diff(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                cur, old = decompress(r.bitmap), decompress(r.p_bitmap)
                common = cur & old
                kinds = [("added", cur & ~old), ("removed", old & ~cur)]
                if common.any():
                    (a1, b1), (a0, b0) = ([np.frombuffer(x, "<f8")[common[bits]] for x in xs] for bits, xs in ((cur, (r.vec_a, r.vec_b)), (old, (r.p_vec_a, r.p_vec_b))))
                    gone1, gone0 = np.isnan(a1) | np.isnan(b1), np.isnan(a0) | np.isnan(b0)
                    with np.errstate(invalid="ignore"):
                        far = haversine_np(a0, b0, a1, b1) > tolerance_m
                    moved = np.zeros_like(common)
                    moved[np.flatnonzero(common)] = (gone1 != gone0) | (~gone1 & ~gone0 & far)
                    kinds.append(("changed", moved))
                for kind, bits in kinds:
                    if len(at := np.flatnonzero(bits)):
                        yield pd.DataFrame({"ordinal": at + (int(r.chunk) << CHUNK_BITS), "snap_no": np.int32(r.snap_no), "change_kind": kind})

    return both.mapInPandas(diff, "ordinal bigint, snap_no int, change_kind string")


def snapshot_changes(
    snapshots: DataFrame, snapshot: str, key: str, lat: str, lon: str, loaded: str, tolerance_m: float = 2.0, known: DataFrame | None = None
) -> DataFrame:
    """Added, removed and changed keys of every two consecutive snapshots: key, snap_no, change_kind.

    Keys are read without surrounding white space and in lower case; rows without one, or without a
    snapshot number, don't count. Of several rows of a key in a snapshot the one loaded last holds (a
    null load time is the earliest; equal times are settled by the larger coordinates). NaN
    coordinates count as null. A snapshot number that is missing between two others is an empty
    snapshot. Empty tables give no rows.
    """
    rows = snapshots.select(
        F.col(snapshot).cast("int").alias("snap_no"), normal_id(F.col(key)).alias("key"), F.nanvl(F.col(lat).cast("double"), F.lit(None)).alias("a"),
        F.nanvl(F.col(lon).cast("double"), F.lit(None)).alias("b"), F.col(loaded).alias("at"),
    ).where(F.col("key").isNotNull() & F.col("snap_no").isNotNull())
    # partial aggregation before the shuffle: a key with a third of all rows leaves each task as one row a snapshot
    order = F.struct(F.col("at").isNotNull(), "at", F.col("a").isNotNull(), "a", F.col("b").isNotNull(), "b")
    last = rows.groupBy("snap_no", "key").agg(F.max_by(F.struct("a", "b"), order).alias("v")).select("snap_no", "key", "v.a", "v.b")
    last = cut(last)
    ordinals = cut(extend_ordinals(last, known))
    packed = cut(pack_snapshots(last.join(ordinals, "key").select("snap_no", "ordinal", "a", "b")))
    ends = packed.agg(F.min("snap_no").alias("lo"), F.max("snap_no").alias("hi"))
    nums = ends.where("hi > lo").select(F.explode(F.sequence(F.col("lo") + 1, F.col("hi"))).alias("snap_no"))
    return compare_packed(packed, nums, tolerance_m).join(ordinals, "ordinal").select("key", "snap_no", "change_kind")
