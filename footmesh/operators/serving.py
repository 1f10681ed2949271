"""Serving of results: which stored result answers a request, how long it lasts and what makes it void.

A log of earlier results is a table of (key, kind, polygon, retry_at, updated_at). Lookups are joins of
requests with the newest entry of their key; the order of the places a result may come from is a coalesce.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footmesh.functions.scalars import clamp_radius, half_up
from footmesh.operators.stops import TYPES

# Radii that the shipped files cover, defaults, milliseconds until another attempt, the least of these, and days an entry lasts.
SHIPPED_RADII = {"tram": (300, 350, 400, 450, 500, 550), "train": (400, 450, 500, 550, 600, 650), "bus": (200, 250, 300, 350, 400, 450)}
DEFAULT_SHAPE, DEFAULT_CROSSINGS = "walkshed", True
TRANSIENT_MS, NO_DATA_MS, LEAST_MS = 120_000, 86_400_000, 1_000


def shipped_radius(type_: Column, radius: Column) -> Column:
    """Whether the shipped files have this radius for this type; false for null and unknown types."""
    out = F.lit(False)
    for t, radii in SHIPPED_RADII.items():
        out = out | ((type_ == t) & radius.isin(*radii))
    return F.coalesce(out, F.lit(False))


def shipped_eligible(is_custom: Column, type_: Column, radius: Column, crossings: Column, built_with: bool = DEFAULT_CROSSINGS) -> Column:
    """A shipped polygon may answer: not a user's stop, a radius that is built, crossings as in the build."""
    return ~F.coalesce(is_custom, F.lit(False)) & shipped_radius(type_, radius) & (crossings == built_with)


def shipped_configuration(settings: DataFrame, shape: str = DEFAULT_SHAPE, crossings: bool = DEFAULT_CROSSINGS) -> DataFrame:
    """``settings``: profile, type, radius_m, shape, crossings, a row a type. A row a profile: whether the shipped files cover it.

    A profile that lacks one of the types, or has a null anywhere, is not covered.
    """
    ok = shipped_radius(F.col("type"), F.col("radius_m")) & F.coalesce((F.col("shape") == shape) & (F.col("crossings") == crossings), F.lit(False))
    return settings.groupBy("profile").agg((F.count_distinct(F.when(ok, F.col("type"))) == len(SHIPPED_RADII)).alias("_all"), F.bool_and(ok).alias("_ok")).select("profile", (F.col("_all") & F.col("_ok")).alias("covered"))


def graph_key(area_key: Column, crossings: Column) -> Column:
    return F.concat_ws(":", area_key, F.when(crossings, "crossings").otherwise("mapped-only"))


def distinct_points(polygon: Column) -> Column:
    return F.size(F.array_distinct(F.transform(polygon, lambda p: F.struct(p["lat"] + 0.0, p["lon"] + 0.0))))


def valid_entry() -> Column:
    """A stored entry may be used: a key; a polygon of three points or more, three of them distinct, all on the globe; or a finite time of another attempt."""
    on_globe = F.forall("polygon", lambda p: F.coalesce(p["lat"].between(-90, 90) & p["lon"].between(-180, 180), F.lit(False)))
    polygon = (F.col("kind") == "polygon") & (F.size("polygon") >= 3) & on_globe & (distinct_points(F.col("polygon")) >= 3)
    other = (F.col("kind") == "unavailable") & F.col("retry_at").isNotNull()
    return F.coalesce((F.length("key") > 0) & F.col("updated_at").isNotNull() & (polygon | other), F.lit(False))


def bounded_wait_ms(wait: Column) -> Column:
    """Milliseconds until another attempt, rounded half up, at least a second; null stays null."""
    return F.when(wait.isNotNull(), F.greatest(F.lit(LEAST_MS), half_up(wait)).cast("bigint"))


def retry_ms(transient: Column) -> Column:
    """Shared network failed: soon; no data, or no edge nearby: much later."""
    return F.when(transient, TRANSIENT_MS).otherwise(NO_DATA_MS)


def next_marker(previous: Column, now_ms: Column) -> Column:
    """The reset marker grows with every reset, whatever the clock does; one that is no whole number counts as none."""
    old = F.when(previous.rlike(r"^[+-]?\d{1,16}$"), previous).try_cast("bigint")
    return F.when(old.isNull(), now_ms).otherwise(F.greatest(now_ms, old + 1))


def last_before(probes: DataFrame, entries: DataFrame, key: str, at: str, seen_at: str, fields: list[str], bucket: Column) -> DataFrame:
    """``probes`` with ``fields`` of the newest entry of their key that was stored at or before ``at``; null where there is none.

    An as-of join without pairs: both are one stream by key and time. ``bucket`` (of the column "t", growing
    with it, as a day) splits a hot key: the newest entry of each bucket is carried into the later ones, so
    no task sorts more than a key's bucket. Ties of time are settled by the larger fields.
    """
    value = F.struct(F.lit(1).alias("is"), *fields)
    null = F.lit(None).cast(entries.select(value.alias("v")).schema["v"].dataType)
    left = probes.select(F.struct(*probes.columns).alias("p"), F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("o"), null.alias("v"))
    right = entries.select(F.lit(None).cast(left.schema["p"].dataType).alias("p"), F.col(key).alias("k"), F.col(seen_at).alias("t"), F.lit(0).alias("o"), value.alias("v"))
    both = left.unionByName(right.where("k is not null and t is not null")).withColumn("b", bucket)
    ends = both.where("o = 0").groupBy("k", "b").agg(F.max_by("v", F.struct("t", "v")).alias("end"))
    spots = both.select("k", "b").distinct().join(ends, ["k", "b"], "left")
    past = W.partitionBy("k").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    carried = spots.withColumn("carry", F.last("end", ignorenulls=True).over(past)).select("k", "b", "carry")
    inside = W.partitionBy("k", "b").orderBy("t", "o", "v").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = both.withColumn("own", F.last("v", ignorenulls=True).over(inside)).where("o = 1")
    rows = rows.join(carried.withColumnsRenamed({"k": "ck", "b": "cb"}), F.expr("k <=> ck and b <=> cb"), "left")
    found = F.coalesce("own", "carry")
    return rows.select("p.*", *(F.when(F.col("k").isNotNull(), found[f]).alias(f"found_{f}") for f in fields))


def answer(status: DataFrame) -> DataFrame:
    """Add ``answer`` to requests whose stored results are joined on: where each is answered from.

    ``memory``, ``persisted``, ``shipped``: booleans, whether a polygon is there; ``retry_at``: of a stored
    failure; ``at``: time of the request; ``current``: whether nothing was reset or moved since. The first
    of memory, persisted and shipped serves; memory also serves what is no longer current. A stored failure
    answers until its time, and everything else is pending.
    """
    stale = ~F.col("current")
    out = F.when(F.col("memory"), "memory").when(stale, "superseded").when(F.col("persisted"), "persisted").when(F.col("shipped"), "shipped")
    return status.withColumn("answer", out.when(F.col("retry_at") > F.col("at"), "cached-unavailable").otherwise("pending"))


def settle(pending: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """``pending`` (key, version, current_version) with ``results`` (key, status, reason): status and reason of each.

    Without a result, or where a polygon came for an old version, the request is superseded; an old version's
    failure is still reported, but ``stored`` is false.
    """
    rows = pending.join(results, key, "left")
    same = F.col("version").eqNullSafe(F.col("current_version"))
    status = F.when(F.col("status").isNull() | ((F.col("status") == "polygon") & ~same), "superseded").otherwise(F.col("status"))
    return rows.select(key, status.alias("status"), F.when(status == "unavailable", F.col("reason")).alias("reason"), (same & F.col("status").isNotNull()).alias("stored"))


def invalidate(entries: DataFrame, stop_ids: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(entries kept, keys removed) when the results of stops are made void. ``stop_ids``: id.

    A result belongs to a stop when its key begins with the id and a colon. Ids may hold colons, so a key has
    as many candidates as it has colons, and these are equi-joined: no pair of keys and ids is ever tested.
    Ids are trimmed, empty and null ones mean nothing.
    """
    ids = stop_ids.select(F.trim("id").alias("_id")).where("_id <> ''").distinct()
    heads = F.expr(f"transform(filter(sequence(1, length(`{key}`)), i -> substr(`{key}`, i, 1) = ':'), i -> left(`{key}`, i - 1))")
    gone = entries.where(F.length(key) > 0).select(key, F.explode(heads).alias("_id")).join(ids, "_id", "left_semi").select(key).distinct()
    return entries.join(gone, key, "left_anti"), gone


def removed_keys(before: DataFrame, after: DataFrame, key: str = "key") -> DataFrame:
    """Keys that pruning took away."""
    return before.select(key).where(F.col(key).isNotNull()).distinct().join(after.select(key), key, "left_anti")


def preloaded(wanted: DataFrame, datasets: DataFrame) -> DataFrame:
    """``wanted``: type, radius_m; ``datasets``: type, radius_m, valid. One row: whether at least one is wanted and all are there and valid."""
    there = datasets.groupBy("type", "radius_m").agg(F.bool_and("valid").alias("_ok"))
    rows = wanted.select("type", "radius_m").distinct().join(there, ["type", "radius_m"], "left")
    return rows.agg(((F.count("*") > 0) & F.coalesce(F.bool_and(F.coalesce("_ok", F.lit(False))), F.lit(False))).alias("ready"), F.count("*").alias("wanted"), F.count_if("_ok").alias("loaded"))


def latest_values(settings: DataFrame, newest: bool = True) -> DataFrame:
    """``settings``: profile, key, value, at. The value of each profile's key that was stored last (or first); nulls were never stored."""
    rows = settings.where("profile is not null and key is not null and value is not null").groupBy("profile", "key")
    pick = F.max_by if newest else F.min_by
    return rows.agg(pick("value", F.struct("at", "value")).alias("value"))


def configured_radii(values: DataFrame) -> DataFrame:
    """profile, type, radius_m: the type's own radius, else the one stored for all, else the type's default, clamped to the steps."""
    types = F.explode(F.array(*(F.struct(F.lit(t).alias("type"), F.lit(d).alias("fallback")) for t, d in TYPES.items())))
    own = F.max(F.when(F.col("key") == F.concat(F.lit("radius-"), F.col("type")), F.col("value")))
    shared = F.max(F.when(F.col("key") == "radius", F.col("value")))
    rows = values.withColumn("_t", types).select("profile", "key", "value", "_t.type", "_t.fallback").groupBy("profile", "type", "fallback").agg(own.alias("own"), shared.alias("shared"))
    return rows.select("profile", "type", clamp_radius(F.coalesce("own", "shared"), F.col("fallback")).alias("radius_m"))


def normal_ids(ids: Column) -> Column:
    """Distinct trimmed ids of an array, empty ones and nulls left out, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))))
