"""Ordered folds over event logs: smoothed latencies, caches, newest-first retention."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footmesh.operators.nested import Level, child_level, one_each
from footmesh.operators.stops import numbered
from footmesh.runtime import cut, map_groups

# The smoothing, milliseconds of an endpoint not seen yet, of a failure and of the preferred one, and the longest streak that counts.
SMOOTHING, UNKNOWN_MS, PENALTY_MS, BONUS_MS, STREAK = 0.25, 700, 1500, 120, 6
MAX_POLYGONS, MAX_UNAVAILABLE, MAX_AGE_DAYS = 4000, 1000, 30
SEGMENT = 20_000
# Events after which the average has all but forgotten what was before them.
PREFIX = 128


def attempts(responses: DataFrame) -> DataFrame:
    """record_id, area_id, attempt_no, endpoint, duration_ms, outcome, status, response (VARIANT) of every request attempt."""
    rows = one_each(responses, "record_id", "body", "received_at").select(F.col("row_key").cast("bigint").alias("record_id"), F.try_variant_get("value", "$.batch.area_id", "string").alias("area_id"), "value")
    rows = child_level(rows, Level("$.attempts[]", "$", "attempts", "list"), keep=("record_id", "area_id")).withColumnRenamed("ord", "attempt_no").where(~F.is_variant_null("value"))
    field = lambda name, kind: F.try_variant_get("value", f"$.{name}", kind).alias(name)
    return rows.select("record_id", "area_id", "attempt_no", field("endpoint", "string"), field("duration_ms", "bigint"), field("outcome", "string"), field("status", "int"), field("response", "variant"))


def smooth(value: np.ndarray, x: float) -> np.ndarray:
    return np.floor(value * (1 - SMOOTHING) + x * SMOOTHING + 0.5)


def steps_of(xs: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """The latency after ``xs`` as a step function of the one before, from 0 to ``top``: where its steps begin, and their values.

    The function grows, so its steps are found by halving between places with different values; after some
    PREFIX events it has only a few of them, whatever the durations are.
    """
    edges = np.array([0.0, top])
    run = lambda v: [v := smooth(v, x) for x in xs][-1] if len(xs) else v
    values = run(edges)
    while True:
        open_ = np.flatnonzero((values[1:] != values[:-1]) & (edges[1:] - edges[:-1] > 1))
        if not len(open_):
            break
        mids = np.floor((edges[open_] + edges[open_ + 1]) / 2)
        edges, values = np.insert(edges, open_ + 1, mids), np.insert(values, open_ + 1, run(mids))
    keep = np.r_[True, values[1:] != values[:-1]]
    return edges[keep], values[keep]


def smoothed_latency(log: DataFrame, group: str, order: list[str], value: str, ok: Column) -> DataFrame:
    """group, latency_ms, failure_streak, successes after all events of each group, in order.

    The latency is an exponential average that is rounded at every step, so it is no plain weighted sum;
    but each stretch of events is a monotone step function of the latency before it, and such functions
    can be composed. Stretches of SEGMENT events are reduced in parallel to their few steps, or kept as
    they are if they are short, and then applied one after the other: a group of any size never meets in
    one task. Null values count as failures of no duration.
    """
    rows = log.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), *order, F.coalesce(value, F.lit(0)).cast("double").alias("x"), ok.alias("ok"))
    first = order[0]
    width = F.floor(F.xxhash64("g") * 0 + F.col(first) / 64).cast("bigint")
    rows = numbered(rows, ["g"], width, order, "no").withColumn("seg", F.floor(F.col("no") / SEGMENT).cast("bigint"))
    rows = cut(rows)
    top = float(max(rows.agg(F.max("x")).first()[0] or 0.0, UNKNOWN_MS)) + 1

    def reduce_segment(key: tuple, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        good = frame["ok"].to_numpy(bool)
        xs = np.maximum(1, np.floor(frame["x"].to_numpy()[good] + 0.5))
        edges, values, fresh = np.empty(0), np.empty(0), None
        if len(xs) > PREFIX:
            edges, values = steps_of(xs[:PREFIX], top)
            # an endpoint that is new begins with the first event's duration
            fresh = np.array([xs[0]])
            for x in xs[1:PREFIX]:
                fresh = smooth(fresh, x)
            state = np.r_[fresh, values]
            for x in xs[PREFIX:]:
                state = smooth(state, x)
            fresh, values, xs = float(state[0]), state[1:], np.empty(0)
        tail = int(np.argmax(good[::-1])) if good.any() else len(good)
        yield pd.DataFrame({"g": [key[0]], "seg": [key[1]], "edges": [edges.tolist()], "values": [values.tolist()], "fresh": [fresh], "xs": [xs.tolist()], "n_ok": [int(good.sum())], "tail": [tail], "n": [len(good)]})

    schema = f"g {dict(rows.dtypes)['g']}, seg bigint, edges array<double>, values array<double>, fresh double, xs array<double>, n_ok bigint, tail bigint, n bigint"
    parts = map_groups(rows.select("g", "seg", "no", "x", "ok"), ["g", "seg"], reduce_segment, schema, ["no"])

    def chain(key: tuple, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        state, streak, good = -1.0, 0, 0
        for r in frame.sort_values("seg").itertuples(index=False):
            if len(r.values):
                state = float(r.fresh) if state < 0 else float(r.values[int(np.searchsorted(np.asarray(r.edges), state, side="right")) - 1])
            for x in r.xs:
                state = float(x) if state < 0 else float(smooth(np.float64(state), x))
            streak = int(r.tail) if r.n_ok else streak + int(r.n)
            good += int(r.n_ok)
        yield pd.DataFrame({"g": [key[0]], "latency_ms": [int(state) if state >= 0 else UNKNOWN_MS], "failure_streak": [min(STREAK, streak)], "successes": [good]})

    out = map_groups(parts, ["g"], chain, f"g {dict(rows.dtypes)['g']}, latency_ms bigint, failure_streak bigint, successes bigint", ["seg"])
    return out.withColumnRenamed("g", group)


def endpoint_ranks(stats: DataFrame, preferred: DataFrame | None = None, ordinals: DataFrame | None = None) -> DataFrame:
    """Endpoints by score, the smaller first; equal ones by their place in the list, or by name. There is a row an endpoint, so one task ranks them.

    ``preferred`` (endpoint, at most one row) takes a bonus; ``ordinals`` (endpoint, ordinal) is the default order.
    """
    score, order = F.col("latency_ms") + F.col("failure_streak") * PENALTY_MS, ["endpoint"]
    if preferred is not None:
        stats = stats.join(F.broadcast(preferred.select("endpoint", F.lit(True).alias("_liked"))), "endpoint", "left")
        score = score - F.when(F.coalesce("_liked", F.lit(False)), BONUS_MS).otherwise(0)
    if ordinals is not None:
        stats, order = stats.join(F.broadcast(ordinals), "endpoint", "left"), ["ordinal", "endpoint"]
    return stats.withColumn("score", score).withColumn("rank", F.row_number().over(W.orderBy("score", *order))).drop("_liked")


def weighted_lru(accesses: DataFrame, group: str, order: list[str], key: str, weight: str, max_entries: int, max_weight: float) -> DataFrame:
    """group, key, evicted_at (number of the access in its group): what a least-recently-used cache of each group evicts.

    The newest entry stays even if it is too heavy alone. A group's accesses stream through one task in
    order; only the cache itself is held, which max_entries bounds.
    """
    rows = accesses.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select(F.col(group).alias("g"), *order, F.col(key).alias("k"), F.coalesce(weight, F.lit(0)).cast("double").alias("w"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, no, held, total = None, 0, OrderedDict(), 0.0
        for frame in frames:
            out = []
            for g, k, w in zip(frame["g"], frame["k"], frame["w"]):
                if g != now:
                    now, no, held, total = g, 0, OrderedDict(), 0.0
                total += w - held.pop(k, 0.0)
                held[k] = w
                while len(held) > max_entries or (len(held) > 1 and total > max_weight):
                    old, gone = held.popitem(last=False)
                    total -= gone
                    out.append((g, old, no))
                no += 1
            yield pd.DataFrame(out, columns=["g", "k", "evicted_at"], dtype=object)

    types = dict(rows.dtypes)
    ordered = rows.repartition("g").sortWithinPartitions("g", *order, "k")
    return ordered.mapInPandas(run, f"g {types['g']}, k {types['k']}, evicted_at bigint").withColumnsRenamed({"g": group, "k": key})


def prune_cache(entries: DataFrame, now: Column) -> DataFrame:
    """``entries``: key, kind, updated_at. The fresh ones that stay: the newest polygons, then the newest others in the room left.

    Both limits are the feature; each is a top-k that never gathers more than k rows a task.
    """
    fresh = entries.where(F.col("updated_at") >= now - F.expr(f"interval {MAX_AGE_DAYS} days"))
    newest = [F.desc("updated_at"), F.asc("key")]
    polygons = fresh.where("kind = 'polygon'").orderBy(*newest).limit(MAX_POLYGONS)
    room = polygons.agg(F.least(F.lit(MAX_UNAVAILABLE), F.greatest(F.lit(0), F.lit(MAX_POLYGONS) - F.count("*"))).alias("room"))
    others = fresh.where("kind <> 'polygon'").orderBy(*newest).limit(MAX_UNAVAILABLE)
    # at most MAX_UNAVAILABLE rows are ranked here
    ranked = others.withColumn("_rn", F.row_number().over(W.orderBy(*newest))).join(F.broadcast(room)).where("_rn <= room").drop("_rn", "room")
    return polygons.unionByName(ranked)


def debounce(events: DataFrame, group: str, at: str, gap: str) -> DataFrame:
    """The end of each burst: group, first_at, last_at, n; a burst ends when nothing follows within the gap. Works on streams with a watermark too."""
    w = F.session_window(at, gap)
    return events.where(F.col(group).isNotNull() & F.col(at).isNotNull()).groupBy(group, w).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n")).drop("session_window")
