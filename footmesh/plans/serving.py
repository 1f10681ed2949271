"""Queries of the stop register's making, of serving results, of the map's view and of the offline build, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footmesh.functions import codec, scalars
from footmesh.operators import build, etl, folds, serving, stops, viewport
from footmesh.operators.hull import hulls
from footmesh.plans import netsql as S
from footmesh.plans.relations import ATTEMPTS, NUM, RADIUS, VALID, stop_valid
from footmesh.plans.walking import BOUNDARY, LOCAL, SOLID, Walk
from footmesh.runtime import cut, table
from footmesh.sources import datasets, guards
from footmesh.sources import network as N

# The time that counts as now, for what expires.
NOW = "2025-02-20 00:00:00"
TAGS = ("name", "railway", "highway", "amenity", "public_transport", "train", "tram", "light_rail", "bus", "trolleybus")


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def tagged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with tags as a source would deliver them: the register's rows written as tags (those whose origin is unknown in the newer way), and the tagged nodes of the network."""
    rows = table(spark, sf_dir, "stops").where("type in ('tram', 'train', 'bus')")
    kind = lambda t, yes: F.when(F.col("type") == t, yes)
    old, given = F.col("is_custom").isNotNull(), {
        "name": F.col("name"), "railway": F.when(F.col("is_custom").isNotNull(), kind("tram", "tram_stop").when(F.col("type") == "train", "station")), "highway": F.when(F.col("is_custom").isNotNull(), kind("bus", "bus_stop")),
        "public_transport": F.when(F.col("is_custom").isNull(), "station"), "train": kind("train", "yes"), "tram": kind("tram", "yes"), "bus": kind("bus", "yes"),
    }
    as_map = lambda made: F.map_from_arrays(F.array(*(F.lit(t) for t in TAGS)), F.array(*(made(t) for t in TAGS)))
    none = F.lit(None).cast("string")
    register = rows.select(F.regexp_extract("id", "([0-9]+)$", 1).try_cast("bigint").alias("id"), "lat", "lon", as_map(lambda t: F.when(old | ~old, given.get(t, none))).alias("tags"))
    elems = N.elements(table(spark, sf_dir, "network_responses")).where("kind = 'node'")
    lat, lon = (F.try_variant_get("value", f"$.{c}", "double") for c in ("lat", "lon"))
    listed = N.as_map(F.try_variant_get("value", "$.tags", "variant"))
    network = elems.select("id", lat.alias("lat"), lon.alias("lon"), as_map(lambda t: N.tag(listed, t)).alias("tags"))
    return register.unionByName(network)


def etl_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.stops_from_nodes(tagged_nodes(spark, sf_dir))


def stop_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops with their place by name in German order."""
    return etl.german_order(stop_valid(spark, sf_dir)).select("id", "name", "pos")


def stop_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a stop id: type, whether a user added it, and when it last changed."""
    rows = table(spark, sf_dir, "stops").where("id is not null")
    return rows.groupBy(F.col("id").alias("stop_id")).agg(F.min("type").alias("type"), F.bool_or(F.coalesce("is_custom", F.lit(False))).alias("is_custom"), F.max("updated_at").alias("moved_at"))


def keyed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of known stops at a place, with the key of their result."""
    rows = table(spark, sf_dir, "requests").where("request_id is not null and stop_id is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").distinct()
    rows = rows.join(stop_of(spark, sf_dir), "stop_id")
    fallback = F.coalesce(stops.default_radius(F.col("type")), F.lit(300.0))
    rows = rows.withColumn("radius", scalars.clamp_radius(F.col("radius_m"), fallback))
    return rows.withColumn("key", codec.result_key(F.col("stop_id"), "crossings", F.col("radius"), F.col("lat"), F.col("lon")))


def results_log(asked: DataFrame) -> DataFrame:
    """What earlier requests left in the store: a polygon, or for those without a radius a failure and the time of another attempt."""
    kind = F.when(F.col("radius_m").isNull(), "unavailable").otherwise("polygon")
    rows = asked.select("key", kind.alias("kind"), F.col("received_at").alias("updated_at")).distinct()
    return rows.withColumn("retry_at", F.when(F.col("kind") == "unavailable", F.col("updated_at") + F.expr(f"interval {serving.NO_DATA_MS // 1000} seconds")))


def serve_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each request is answered from, by what earlier requests of its key had left in the store."""
    asked = cut(keyed_requests(spark, sf_dir))
    rows = serving.last_before(asked, results_log(asked), "key", "requested_at", "updated_at", ["kind", "updated_at", "retry_at"], F.to_date("t"))
    polygon = F.coalesce(F.col("found_kind") == "polygon", F.lit(False))
    age = F.col("requested_at") - F.col("found_updated_at")
    status = rows.select(
        "request_id", F.col("requested_at").alias("at"), (polygon & F.coalesce(age <= F.expr("interval 1 hour"), F.lit(False))).alias("memory"),
        (polygon & F.coalesce(age <= F.expr("interval 30 days"), F.lit(False))).alias("persisted"), F.col("found_retry_at").alias("retry_at"),
        serving.shipped_eligible(F.col("is_custom"), F.col("type"), F.col("radius"), F.lit(True)).alias("shipped"), F.coalesce(F.col("moved_at") <= F.col("requested_at"), F.lit(True)).alias("current"),
    )
    return serving.answer(status).select("request_id", "answer")


def area_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row an area whose network was fetched: the status and reason that a shared fetch gives its requests."""
    rows = guards.payloads(folds.attempts(table(spark, sf_dir, "network_responses"))).where("area_id is not null")
    got = rows.groupBy("area_id").agg(F.coalesce(F.bool_or(F.col("outcome") == "ok"), F.lit(False)).alias("ok"), F.sum("n_elements").alias("n"))
    status = F.when(F.col("ok") & (F.col("n") > 0), "polygon").otherwise("unavailable")
    reason = F.when(~F.col("ok"), "network").when(F.col("n") == 0, "no-data")
    return got.select("area_id", status.alias("status"), reason.alias("reason"))


def serve_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each request once its area's network came, or not, and the milliseconds until another attempt. A stop that changed in between makes its version old."""
    asked = keyed_requests(spark, sf_dir)
    version = lambda at: F.coalesce(F.col("moved_at") <= F.col(at), F.lit(True)).cast("int")
    pending = asked.select("request_id", "area_id", version("requested_at").alias("version"), version("received_at").alias("current_version"))
    results = pending.select("request_id", "area_id").join(area_outcome(spark, sf_dir), "area_id").drop("area_id")
    out = serving.settle(pending.drop("area_id"), results, "request_id")
    return out.withColumn("wait_ms", F.when(F.col("status") == "unavailable", serving.bounded_wait_ms(serving.retry_ms(F.col("reason") == "network"))))


def net_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each attempt with the number of its elements and whether its payload passes as a whole."""
    return guards.payloads(folds.attempts(table(spark, sf_dir, "network_responses"))).select("record_id", "attempt_no", F.col("n_elements").cast("bigint").alias("n_elements"), "valid")


def stored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results, some of them broken, as a store that cannot be trusted holds them."""
    rows = table(spark, sf_dir, "requests").distinct()
    point = lambda dy, dx: F.struct((F.col("lat") + dy).alias("lat"), (F.col("lon") + dx).alias("lon"))
    polygon = F.when(F.col("radius_m").isNotNull(), F.array(point(0.0, 0.0), point(0.001, 0.0), point(0.0, 0.001)))
    kind = F.when(F.col("radius_m").isNull(), "unavailable").otherwise("polygon")
    return rows.select(F.col("request_id").alias("key"), kind.alias("kind"), polygon.alias("polygon"), F.when(F.col("stop_id").isNotNull(), F.col("received_at")).alias("retry_at"), F.col("received_at").alias("updated_at"))


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_entries(spark, sf_dir).select("key", "kind", serving.valid_entry().alias("valid"))


def cache_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: usable polygons in the store, and failures whose time has not come."""
    rows = stored_entries(spark, sf_dir).where(serving.valid_entry())
    return rows.agg(F.count_if(F.col("kind") == "polygon").alias("polygons"), F.count_if((F.col("kind") == "unavailable") & (F.col("retry_at") > now())).alias("failures"))


def cache_invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored keys, and whether the stops that lost their type make them void."""
    keys = cut(keyed_requests(spark, sf_dir).select("key").distinct())
    kept, gone = serving.invalidate(keys, table(spark, sf_dir, "stops").where("type is null").select("id"))
    return kept.select("key", F.lit(False).alias("removed")).unionByName(gone.select("key", F.lit(True).alias("removed")))


def cache_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that pruning at NOW takes away."""
    rows = table(spark, sf_dir, "requests").select(F.col("request_id").alias("key"), F.when(F.col("radius_m").isNull(), "unavailable").otherwise("polygon").alias("kind"), F.col("requested_at").alias("updated_at")).distinct()
    return serving.removed_keys(rows, folds.prune_cache(rows, now()))


def cache_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store of early February with what came later put over it; a later failure deletes."""
    asked = cut(keyed_requests(spark, sf_dir))
    rows = results_log(asked).groupBy("key", "updated_at").agg(F.max("kind").alias("kind"))
    early = F.col("updated_at") < F.lit("2025-02-01 00:00:00").cast("timestamp_ntz")
    stored = rows.where(early).groupBy("key").agg(F.max_by("kind", "updated_at").alias("kind"), F.max("updated_at").alias("updated_at"))
    changes = rows.where(~early).select("key", F.when(F.col("kind") == "polygon", F.col("kind")).alias("kind"), "updated_at")
    return datasets.upserted(stored, changes, "key", "updated_at").select("key", "kind", "updated_at")


def shipped_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that a shipped file may answer, with its name and the key in it."""
    rows = keyed_requests(spark, sf_dir).where(serving.shipped_eligible(F.col("is_custom"), F.col("type"), F.col("radius"), F.lit(True)))
    name = F.concat(F.lit("walksheds-"), F.col("type"), F.lit("-"), F.col("radius").cast("bigint").cast("string"), F.lit(".json"))
    return rows.select("request_id", name.alias("filename"), codec.polygon_key(F.col("stop_id"), F.col("type"), F.col("lat"), F.col("lon")).alias("polygon_key"))


def stored_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings as key and text: the radius that was asked of each type in an area, and for stops unknown that of all types."""
    asked = table(spark, sf_dir, "requests").distinct().join(stop_of(spark, sf_dir).select("stop_id", "type"), "stop_id", "left")
    return asked.select(F.col("area_id").alias("profile"), F.concat_ws("-", F.lit("radius"), "type").alias("key"), F.col("radius_m").cast("string").alias("value"), F.col("requested_at").alias("at"))


def settings_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.configured_radii(serving.latest_values(stored_settings(spark, sf_dir)))


def settings_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settings_radii(spark, sf_dir).withColumns({"shape": F.lit("walkshed"), "crossings": F.lit(True)})
    return serving.shipped_configuration(rows)


def settings_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the radii of a profile differ from those it had first."""
    stored = cut(stored_settings(spark, sf_dir))
    new, old = (serving.configured_radii(serving.latest_values(stored, newest)) for newest in (True, False))
    return viewport.record_changed(new, old, "profile", "type", "radius_m")


def settings_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a profile: how many types are shown (trams and trains, and whatever was asked for), and the span of the radii."""
    own = serving.latest_values(stored_settings(spark, sf_dir)).where("key like 'radius-%'").select("profile", F.substring("key", 8, 20).alias("type"), F.lit(True).alias("asked"))
    rows = settings_radii(spark, sf_dir).join(own, ["profile", "type"], "left")
    low, high = F.min("radius_m"), F.max("radius_m")
    text = F.when(low == high, F.concat(codec.plain_number(low), F.lit(" m"))).otherwise(F.concat(codec.plain_number(low), F.lit("–"), codec.plain_number(high), F.lit(" m")))
    return rows.groupBy("profile").agg(F.count_if(F.col("type").isin("tram", "train") | F.coalesce("asked", F.lit(False))).alias("visible"), text.alias("radii"))


def views(spark: SparkSession, sf_dir: str, shift: float = 0.0) -> DataFrame:
    """A view an area, around its first stop: view_id, c_lat, c_lon."""
    rows = stop_placed(spark, sf_dir).groupBy(F.col("area_id").alias("view_id")).agg(F.min(F.struct("id", "lat", "lon")).alias("m"))
    return rows.select("view_id", (F.col("m.lat") + shift).alias("c_lat"), F.col("m.lon").alias("c_lon"))


def stop_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid stops, one row an id, with their area."""
    rows = table(spark, sf_dir, "stops").where(stops.valid_stop()).where("area_id is not null")
    return rows.groupBy("id").agg(F.min(F.struct("area_id", "lat", "lon", "type")).alias("m")).select("id", "m.*")


def visible(spark: SparkSession, sf_dir: str, shift: float = 0.0) -> DataFrame:
    """view_id, id, lat, lon, type of the stops in each view and its margin."""
    rows = stop_placed(spark, sf_dir).withColumnRenamed("area_id", "view_id").join(views(spark, sf_dir, shift), "view_id")
    a, b = 0.02 * 1.16, 0.03 * 1.16
    return rows.where(F.col("lat").between(F.col("c_lat") - a, F.col("c_lat") + a) & F.col("lon").between(F.col("c_lon") - b, F.col("c_lon") + b)).select("view_id", "id", "lat", "lon", "type")


def loaded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stops with a polygon, stops being loaded at NOW, stops with a failure and its time)."""
    rows = table(spark, sf_dir, "requests").where("stop_id is not null").withColumnRenamed("stop_id", "id")
    before = rows.where(F.col("received_at") <= now())
    have = before.where("radius_m is not null").select("id")
    active = rows.where((F.col("requested_at") <= now()) & (F.col("received_at") > now())).select("id")
    failed = before.where("radius_m is null").select("id", (F.col("received_at") + F.expr("interval 1 day")).alias("retry_at"))
    return have, active, failed


def view_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible stops that may be queued at NOW; those asked for in the hour before are queued already."""
    have, active, failed = loaded(spark, sf_dir)
    queued = table(spark, sf_dir, "requests").where(F.col("requested_at").between(now() - F.expr("interval 1 hour"), now())).select(F.col("stop_id").alias("id"))
    return viewport.eligible(visible(spark, sf_dir), have, active, queued, failed, now()).select("view_id", "id")


def view_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    have, _, failed = loaded(spark, sf_dir)
    return viewport.progress(visible(spark, sf_dir), have, failed, now())


def view_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops that go out of view when each view moves north."""
    return visible(spark, sf_dir).join(visible(spark, sf_dir, 0.01), ["view_id", "id"], "left_anti").select("view_id", "id")


def view_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each request's result may still be shown: its stop unchanged and in view, and asked at the radius that now holds."""
    asked = keyed_requests(spark, sf_dir).select("request_id", F.col("stop_id").alias("id"), "lat", "lon", F.col("radius").alias("radius_m"), F.lit(1).alias("generation"))
    seen = visible(spark, sf_dir).withColumn("visible", F.lit(True)).withColumn("radius_m", stops.default_radius(F.col("type"))).withColumn("generation", F.lit(1))
    return viewport.still_current(asked, seen.select("id", "generation", "radius_m", "lat", "lon", "visible")).select("request_id", "current")


def view_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which visible stops share a request; trains go first. The forming is greedy, so there is no SQL for it."""
    rows = visible(spark, sf_dir).withColumns({"radius_m": stops.default_radius(F.col("type")), "priority": F.col("type") == "train"})
    return viewport.greedy_batches(rows, views(spark, sf_dir))


def net_stop_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of each request's own scan, and how many network nodes lie in it."""
    rows = table(spark, sf_dir, "requests").select(F.col("request_id").alias("key"), "lat", "lon", scalars.clamp_radius(F.col("radius_m"), F.lit(300.0)).alias("r")).distinct()
    rows = rows.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    boxes = cut(rows.select("key", *viewport.box_for_stop(F.col("lat"), F.col("lon"), F.col("r"))))
    held = viewport.nodes_in_boxes(boxes, N.nodes_of(N.elements(table(spark, sf_dir, "network_responses")))).groupBy("key").agg(F.count("*").alias("nodes"))
    out = boxes.join(held, "key", "left")
    return out.select(F.col("key").alias("request_id"), *(F.round(c, 7).alias(c) for c in ("south", "west", "north", "east")), F.coalesce("nodes", F.lit(0)).cast("bigint").alias("nodes"))


def net_single_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stop's own network: walkable ways with a node in its box, and all their nodes wherever they lie. The stop is the first request's."""
    first = table(spark, sf_dir, "requests").where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").orderBy("request_id").limit(1)
    box = first.select(F.col("request_id").alias("key"), *viewport.box_for_stop(F.col("lat"), F.col("lon"), F.lit(400.0)))
    nodes, ways = N.load_network(table(spark, sf_dir, "network_responses"))
    inside = viewport.nodes_in_boxes(box, nodes).select("area_id", "id").distinct()
    refs = ways.select("area_id", *N.ORDER, "nodes", F.explode("nodes").alias("id"))
    mine = refs.join(inside, ["area_id", "id"], "left_semi").select("area_id", *N.ORDER, "nodes").distinct()
    return N.recurse_down(mine, nodes).select("area_id", "id", "lat", "lon")


def build_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred tram and train stops to build: a top-k."""
    return build.select_stops(stop_valid(spark, sf_dir), ("tram", "train"), 100).select("id", "type", "lat", "lon")


def build_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.shards(stop_valid(spark, sf_dir).groupBy("type").agg(F.count("*").alias("stops")))


def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.fetch_report(folds.attempts(table(spark, sf_dir, "network_responses")))


class Build:
    """The offline build over the register: every stop at every radius of its type, routed over its area's network."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.radii = build.radii_table(spark, serving.SHIPPED_RADII)
        placed = stop_placed(spark, sf_dir)
        self.stops = cut(placed.withColumn("polygon_key", codec.polygon_key(F.col("id"), F.col("type"), F.col("lat"), F.col("lon"))))
        wanted = self.stops.join(F.broadcast(self.radii), "type").select(F.concat_ws("|", "polygon_key", F.col("radius_m").cast("bigint").cast("string")).alias("request_id"), "area_id", "lat", "lon", "radius_m")
        self.walk = Walk(spark, sf_dir, wanted=wanted)

    def encoded(self) -> DataFrame:
        """polygon_key, radius_m, encoded of every polygon that came out."""
        rings = hulls(self.walk.local).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("ring"))
        at = F.split("request_id", r"\|")
        return cut(rings.select(at[0].alias("polygon_key"), at[1].cast("double").alias("radius_m"), codec.encode(F.transform("ring", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))).alias("encoded")))


def build_traversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many searches each position needs for the radii of its stops: one a set of seeds."""
    b = Build(spark, sf_dir)
    rows = build.traversals(b.walk.seeds, b.walk.asked)
    return rows.select("area_id", "origin", "max_m", F.size("radii").cast("bigint").alias("radii"), F.col("n_seeds").cast("bigint").alias("seeds"))


def build_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Build(spark, sf_dir)
    return build.variants(b.stops, b.radii, b.encoded())


def build_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipped files with the number of polygons in each."""
    b = Build(spark, sf_dir)
    return build.dataset_outputs(build.dataset_rows(b.stops, b.radii, b.encoded()), b.radii).select("type", "radius_m", "filename", "polygons")


def http_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints in the order in which they are tried next: the one that last succeeded is preferred."""
    rows = cut(folds.attempts(table(spark, sf_dir, "network_responses")).drop("response"))
    stats = folds.smoothed_latency(rows, "endpoint", ["record_id", "attempt_no"], "duration_ms", F.col("outcome") == "ok")
    liked = rows.where("outcome = 'ok' and endpoint is not null").agg(F.max_by("endpoint", F.struct("record_id", "attempt_no")).alias("endpoint")).where("endpoint is not null")
    return folds.endpoint_ranks(stats, liked).select("endpoint", "score", "rank")


def codec_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stop's circle delta-encoded, number by number."""
    ring = scalars.circle(F.col("lat"), F.col("lon"), stops.default_radius(F.col("type")), 16)
    rows = stop_valid(spark, sf_dir).select("id", "type", "lat", "lon", codec.encode(ring).alias("e")).select("id", "type", "lat", "lon", F.posexplode("e").alias("pos", "value"))
    return rows.select("id", "type", "lat", "lon", "pos", "value")


def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each stop's circle comes back from its encoding to within the rounding, and whether the encoding is valid."""
    rows = stop_valid(spark, sf_dir).withColumn("ring", F.transform(scalars.circle(F.col("lat"), F.col("lon"), stops.default_radius(F.col("type")), 16), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))))
    rows = rows.withColumn("e", codec.encode(F.col("ring")))
    off = F.array_max(F.zip_with("ring", codec.decode(F.col("e")), lambda a, b: F.greatest(F.abs(a["lat"] - b["lat"]), F.abs(a["lon"] - b["lon"]))))
    return rows.select("id", "type", "lat", "lon", F.size("e").cast("bigint").alias("numbers"), codec.valid_encoding(F.col("e")).alias("valid"), (off <= 0.500001 / codec.PRECISION).alias("close"))


# Texts that settings and headers may hold, with the reading of each.
RADIUS_TEXTS = (" 300 ", "", "abc", "1e2", "124", "126", "125", "-5", "99999", "NaN", "Infinity", "1d", ".5", "0")
WAIT_TEXTS = ("5", " 1.5 ", "0", "", "soon", "-3", "Thu, 06 Feb 2025 00:00:10 GMT", "Wed, 05 Feb 2025 23:00:00 GMT")


def scalar_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in RADIUS_TEXTS], "text string").select("text", scalars.clamp_radius(F.col("text"), F.lit(300.0)).alias("radius_m"))


def scalar_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds to wait by a header, at 2025-02-06 00:00."""
    return spark.createDataFrame([(t,) for t in WAIT_TEXTS], "text string").select("text", scalars.retry_after_ms(F.col("text"), F.lit(1738800000000.0)).alias("wait_ms"))


QUERIES = {
    f.__name__: f for f in (etl_stops, stop_sorted, serve_lookup, serve_settle, net_payloads, cache_entries, cache_size, cache_invalidated, cache_removed, cache_upserts, shipped_lookup, settings_radii, settings_covered, settings_changed, settings_visible,
                            view_eligible, view_progress, view_left, view_current, view_batches, net_stop_nodes, net_single_stop, build_select, build_shards, build_report, build_traversals, build_variants, build_outputs, http_order, codec_circles, codec_round_trip, scalar_radius, scalar_wait)
}

_NOW = f"timestamp '{NOW}'"
_TRAM = "case when type = 'tram' then 300e0 when type = 'train' then 400e0 when type = 'bus' then 200e0 else 300e0 end"
_SHIPPED = "coalesce((type = 'tram' and {0} in (300, 350, 400, 450, 500, 550)) or (type = 'train' and {0} in (400, 450, 500, 550, 600, 650)) or (type = 'bus' and {0} in (200, 250, 300, 350, 400, 450)), false)"
_STOP = "so as (select id as stop_id, min(type) as type, bool_or(coalesce(is_custom, false)) as is_custom, max(updated_at) as moved_at from stops where id is not null group by 1)"
KEYED = f"""{_STOP}, kq as (
  select *, stop_id || ':v2:crossings:' || cast(cast(radius as bigint) as varchar) || ':' || format('{{:.6f}}', lat) || ':' || format('{{:.6f}}', lon) as key from (
    select *, case when radius_m is null or isnan(radius_m) or isinf(radius_m) then {_TRAM} else least(2000e0, greatest(100e0, floor(radius_m / 50 + 0.5) * 50)) end as radius
    from (select distinct * from requests where request_id is not null and stop_id is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)) join so using (stop_id)))"""
_LOG = "lg as (select distinct key, case when radius_m is null then 'unavailable' else 'polygon' end as kind, received_at as updated_at from kq)"
_PLACED = """pl as (select id, m.area_id as area_id, m.lat as lat, m.lon as lon, m.type as type from (select id, min(struct_pack(area_id := area_id, lat := lat, lon := lon, type := type)) as m from stops
  where id is not null and name is not null and lat is not null and lon is not null and isfinite(lat) and isfinite(lon) and type in ('tram', 'train', 'bus') and area_id is not null group by id)
), vw as (select area_id as view_id, arg_min(lat, id) as c_lat, arg_min(lon, id) as c_lon from pl group by 1)"""


def _visible(name: str, shift: str = "0e0") -> str:
    return f"{name} as (select view_id, id, lat, lon, type from pl join vw on area_id = view_id where lat between c_lat + {shift} - 0.02e0 * 1.16e0 and c_lat + {shift} + 0.02e0 * 1.16e0 and lon between c_lon - 0.03e0 * 1.16e0 and c_lon + 0.03e0 * 1.16e0)"


_FAILED = f"fl as (select stop_id as id, received_at + interval 1 day as retry_at from requests where stop_id is not null and radius_m is null and received_at <= {_NOW})"
_HAVE = f"hv as (select stop_id as id from requests where stop_id is not null and radius_m is not null and received_at <= {_NOW})"
_SETTINGS = f"""{_STOP}, kv as (select area_id as profile, concat_ws('-', 'radius', type) as key, radius_m as value, requested_at as ts from (select distinct * from requests) left join so using (stop_id) where area_id is not null and radius_m is not null)"""


def _radii(name: str, pick: str) -> str:
    return f"""{name} as (select profile, type, case when v is null or isnan(v) or isinf(v) then fallback else least(2000e0, greatest(100e0, floor(v / 50 + 0.5) * 50)) end as radius_m from (
  select profile, type, fallback, coalesce(max(value) filter (key = 'radius-' || type), max(value) filter (key = 'radius')) as v
  from (select profile, key, {pick}(value, (ts, cast(value as varchar))) as value from kv group by 1, 2), (values ('tram', 300e0), ('train', 400e0), ('bus', 200e0)) t(type, fallback) group by 1, 2, 3))"""


_NUMERIC = "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"
_PAYLOADS = ATTEMPTS.replace(", at2 as", f""", pa as (select record_id, area_id, attempt_no, v, case when json_type(v, '$.response.elements') = 'ARRAY' then json_extract(v, '$.response.elements[*]') end as es from att where json_type(v) <> 'NULL'
), pe as (select record_id, attempt_no, e,
    (json_type(e, '$.type') = 'VARCHAR' and e ->> '$.type' = 'node' and json_type(e, '$.id') in {_NUMERIC} and json_type(e, '$.lat') in {_NUMERIC} and json_type(e, '$.lon') in {_NUMERIC})
    or (json_type(e, '$.type') = 'VARCHAR' and e ->> '$.type' = 'way' and json_type(e, '$.id') in {_NUMERIC} and json_type(e, '$.nodes') = 'ARRAY'
      and coalesce(list_bool_and(list_transform(json_extract(e, '$.nodes[*]'), lambda x: json_type(x) in {_NUMERIC})), true)
      and (json_type(e, '$.tags') is null or (json_type(e, '$.tags') in ('OBJECT', 'ARRAY') and not exists (select 1 from json_each(e, '$.tags') t where t.type <> 'VARCHAR')))) as good
  from (select record_id, attempt_no, unnest(es) as e from pa)
), py as materialized (select pa.record_id, area_id, pa.attempt_no, coalesce(len(es), 0) as n_elements, es is not null and coalesce(g, true) as valid, v ->> '$.outcome' as outcome from pa
  left join (select record_id, attempt_no, bool_and(coalesce(good, false)) as g from pe group by 1, 2) q on q.record_id = pa.record_id and q.attempt_no = pa.attempt_no), at2 as""")
_BUILD = """select id || ':' || type || ':' || {lat} || ':' || {lon} || '|' || r as request_id, area_id, lat, lon, cast(r as double) as radius_m
  from (select *, unnest(case type when 'tram' then [300, 350, 400, 450, 500, 550] when 'train' then [400, 450, 500, 550, 600, 650] else [200, 250, 300, 350, 400, 450] end) as r from pl)""".format(lat=NUM.format("lat"), lon=NUM.format("lon"))
_BUILT = f"with recursive {_PLACED}, {S.CROSS}{S.origins_sql(_BUILD)}{S.PATHS}{BOUNDARY}{LOCAL}{SOLID}, bw as ({_BUILD})"

_RING = f"""with {VALID}, a as (select id, type, lat, lon, ({RADIUS}) / 6371008.8e0 as ang, radians(lat) as phi, unnest(range(0, 17)) as i from sv
), y as (select *, i * (2 * 3.141592653589793e0 / 16) as b from a), z as (select *, asin(sin(phi) * cos(ang) + cos(phi) * sin(ang) * cos(b)) as y from y
), p as (select id, type, lat, lon, i, cast(floor(degrees(y) * 100000 + 0.5) as bigint) as qa, cast(floor(degrees(radians(lon) + atan2(sin(b) * sin(ang) * cos(phi), cos(ang) - sin(phi) * sin(y))) * 100000 + 0.5) as bigint) as qo from z)"""

SQL = {
    "etl_stops": f"""with {S.ELEMENTS}, tg as (
  select try_cast(nullif(regexp_extract(id, '([0-9]+)$', 1), '') as bigint) as id, name, lat, lon, type, is_custom is null as newer from stops where type in ('tram', 'train', 'bus')
  union all
  select id, v ->> '$.tags.name', try_cast(v ->> '$.lat' as double), try_cast(v ->> '$.lon' as double), case v ->> '$.tags.railway' when 'tram_stop' then 'tram' when 'station' then 'train' when 'halt' then 'train' end, false
  from ok where kind = 'node' and (v ->> '$.tags.railway') in ('tram_stop', 'station', 'halt')
), st as (select distinct 'osm-' || id as id, coalesce(name, 'Unbekannte Haltestelle') as name, lat, lon, type, newer from tg where id is not null and isfinite(lat) and isfinite(lon))
select id, name, lat, lon, type from st s where not newer or not exists (
  select 1 from st o where not o.newer and o.name = s.name and sqrt(pow((s.lat - o.lat) * 111320e0, 2) + pow((s.lon - o.lon) * 111320e0 * cos(radians((s.lat + o.lat) / 2)), 2)) <= 150)""",
    "stop_sorted": f"with {VALID} select id, name, row_number() over (order by name collate de, id, lat, lon, type) - 1 as pos from sv",
    "serve_lookup": f"""with {KEYED}, {_LOG}, l1 as (select key, updated_at, max(kind) as kind from lg group by 1, 2), j as (
  select k.*, l.kind, l.updated_at from kq k asof left join l1 l on k.key = l.key and k.requested_at >= l.updated_at)
select request_id, case when kind = 'polygon' and requested_at - updated_at <= interval 1 hour then 'memory' when not coalesce(moved_at <= requested_at, true) then 'superseded'
  when kind = 'polygon' and requested_at - updated_at <= interval 30 day then 'persisted' when not is_custom and {_SHIPPED.format("radius")} then 'shipped'
  when kind = 'unavailable' and updated_at + interval 1 day > requested_at then 'cached-unavailable' else 'pending' end as answer from j""",
    "serve_settle": f"""with {_PAYLOADS}, {KEYED}, oc as (select area_id, coalesce(bool_or(outcome = 'ok'), false) as ok, sum(n_elements) as n from py where area_id is not null group by 1
), j as (select request_id, ok, n, coalesce(moved_at <= requested_at, true) as v, coalesce(moved_at <= received_at, true) as cv from kq left join oc using (area_id)
), s as (select *, case when ok is null then 'superseded' when ok and n > 0 then case when v = cv then 'polygon' else 'superseded' end else 'unavailable' end as status from j)
select request_id, status, case when status = 'unavailable' then case when not ok then 'network' else 'no-data' end end as reason, v = cv and ok is not null as stored,
  cast(case when status = 'unavailable' then case when not ok then 120000 else 86400000 end end as bigint) as wait_ms from s""",
    "net_payloads": f"with {_PAYLOADS} select record_id, cast(attempt_no as integer) as attempt_no, cast(n_elements as bigint) as n_elements, valid from py",
    "cache_entries": """select request_id as key, case when radius_m is null then 'unavailable' else 'polygon' end as kind,
  coalesce(request_id <> '' and received_at is not null and case when radius_m is null then stop_id is not null and received_at is not null
    else lat is not null and lon is not null and lat >= -90 and lat + 0.001e0 <= 90 and lon >= -180 and lon + 0.001e0 <= 180 end, false) as valid from (select distinct * from requests)""",
    "cache_size": f"""select count(*) filter (radius_m is not null and lat >= -90 and lat + 0.001e0 <= 90 and lon >= -180 and lon + 0.001e0 <= 180) as polygons, count(*) filter (radius_m is null and stop_id is not null and received_at > {_NOW}) as failures
from (select distinct * from requests) where request_id <> '' and received_at is not null""",
    "cache_invalidated": f"with {KEYED}, iv as (select distinct trim(id) as id from stops where type is null and trim(id) <> '') select distinct key, exists (select 1 from iv where starts_with(key, iv.id || ':')) as removed from kq",
    "cache_removed": """with b as (select distinct request_id as key from requests), c as (select distinct request_id as key, case when radius_m is null then 'unavailable' else 'polygon' end as kind, requested_at as updated_at from requests where requested_at >= timestamp '2025-01-21 00:00:00'
), r as (select *, row_number() over (partition by kind order by updated_at desc, key) as rn, count(*) filter (kind = 'polygon') over () as polygons from c)
select key from b where key not in (select key from r where (kind = 'polygon' and rn <= 4000) or (kind <> 'polygon' and rn <= least(1000, greatest(0, 4000 - least(polygons, 4000)))))""",
    "cache_upserts": f"""with {KEYED}, {_LOG}, l1 as (select key, updated_at, max(kind) as kind from lg group by 1, 2), l2 as (select *, updated_at < timestamp '2025-02-01 00:00:00' as early from l1
), n as (select key, early, arg_max(kind, updated_at) as kind, max(updated_at) as updated_at from l2 group by 1, 2)
select key, kind, updated_at from n where (early and key not in (select key from n where not early)) or (not early and kind = 'polygon')""",
    "shipped_lookup": f"with {KEYED} select request_id, 'walksheds-' || type || '-' || cast(radius as bigint) || '.json' as filename, stop_id || ':' || type || ':' || {NUM.format('lat')} || ':' || {NUM.format('lon')} as polygon_key from kq where not is_custom and {_SHIPPED.format('radius')}",
    "settings_radii": f"with {_SETTINGS}, {_radii('rd', 'arg_max')} select * from rd",
    "settings_covered": f"with {_SETTINGS}, {_radii('rd', 'arg_max')} select profile, bool_and({_SHIPPED.format('radius_m')}) and count(distinct type) = 3 as covered from rd group by 1",
    "settings_changed": f"with {_SETTINGS}, {_radii('rd', 'arg_max')}, {_radii('ro', 'arg_min')} select rd.profile, bool_or(rd.radius_m <> ro.radius_m) as changed from rd join ro on rd.profile = ro.profile and rd.type = ro.type group by 1",
    "settings_visible": f"""with {_SETTINGS}, {_radii('rd', 'arg_max')}, m as (select profile, min(radius_m) as lo, max(radius_m) as hi, count(*) filter (type in ('tram', 'train') or exists (select 1 from kv where kv.profile = rd.profile and kv.key = 'radius-' || rd.type)) as visible from rd group by 1)
select profile, visible, case when lo = hi then cast(lo as bigint) || ' m' else cast(lo as bigint) || '–' || cast(hi as bigint) || ' m' end as radii from m""",
    "view_eligible": f"""with {_PLACED}, {_visible('vs')}, {_HAVE}, {_FAILED} select view_id, id from vs where id not in (select id from hv) and id not in (select id from fl where retry_at > {_NOW})
  and id not in (select stop_id from requests where stop_id is not null and requested_at <= {_NOW} and received_at > {_NOW}) and id not in (select stop_id from requests where stop_id is not null and requested_at between {_NOW} - interval 1 hour and {_NOW})""",
    "view_progress": f"""with {_PLACED}, {_visible('vs')}, {_HAVE}, {_FAILED}, p as (select view_id, id in (select id from hv) as have, id in (select id from fl where retry_at > {_NOW}) as off from vs)
select view_id, count(*) as total, count(*) filter (have) as loaded, count(*) filter (not have and off) as unavailable, count(*) filter (not have and not off) as pending from p group by 1""",
    "view_left": f"with {_PLACED}, {_visible('v0')}, {_visible('v1', '0.01e0')} select view_id, id from v0 where id not in (select id from v1)",
    "view_current": f"with {KEYED}, {_PLACED}, {_visible('vs')} select request_id, coalesce(v.lat = k.lat and v.lon = k.lon and k.radius = case v.type when 'tram' then 300 when 'train' then 400 else 200 end, false) as current from kq k left join vs v on v.id = k.stop_id",
    "net_stop_nodes": f"""with {S.ELEMENTS}, b0 as (select distinct request_id, lat, lon, {S.CLAMP} + 80 as r from requests where lat is not null and lon is not null and not isnan(lat) and not isnan(lon)
), b1 as (select *, lat - r / 111320e0 as south, lat + r / 111320e0 as north from b0), b2 as (select *, r / (111320e0 * greatest(0.2e0, cos(radians(greatest(abs(south), abs(north)))))) as d from b1
), b as (select request_id, south, lon - d as west, north, lon + d as east from b2)
select request_id, round(south, 7) as south, round(west, 7) as west, round(north, 7) as north, round(east, 7) as east, (select count(*) from nd where nd.lat between south and north and nd.lon between west and east) as nodes from b""",
    "net_single_stop": f"""with {S.ELEMENTS}, f as (select lat, lon from requests where lat is not null and lon is not null and not isnan(lat) and not isnan(lon) order by request_id limit 1
), b as (select lat - 480 / 111320e0 as south, lat + 480 / 111320e0 as north, lon, 480 / (111320e0 * greatest(0.2e0, cos(radians(greatest(abs(lat - 480 / 111320e0), abs(lat + 480 / 111320e0)))))) as d from f
), hit as (select distinct r.area_id, record_id, attempt_no, elem_ord from refs r join nd using (area_id, id), b where nd.lat between south and north and nd.lon between b.lon - d and b.lon + d)
select distinct nd.area_id, nd.id, nd.lat, nd.lon from refs r semi join hit using (area_id, record_id, attempt_no, elem_ord) join nd using (area_id, id)""",
    "build_select": f"with {VALID} select id, type, lat, lon from sv where type in ('tram', 'train') order by id, lat, lon, type limit 100",
    "build_shards": f"with {VALID} select type, stops, row_number() over (order by stops desc, o) - 1 as pos from (select t.type, t.o, count(sv.id) as stops from (values ('tram', 0), ('train', 1), ('bus', 2)) t(type, o) left join sv using (type) group by 1, 2)",
    "build_report": f"""with {ATTEMPTS}, b as (select coalesce(cast(status as varchar), 'network') as s, count(*) as n from at2 group by 1)
select count(*) as attempts, count(*) filter (outcome is distinct from 'ok') as failures, cast(sum(coalesce(duration_ms, 0)) as bigint) as total_ms, max(coalesce(duration_ms, 0)) as max_ms, cast(floor(sum(coalesce(duration_ms, 0)) / count(*) + 0.5) as bigint) as average_ms,
  format('{{:.1f}}s', max(coalesce(duration_ms, 0)) / 1000e0) as max_text, (select string_agg(s || '×' || n, ', ' order by s || '×' || n) from b) as by_status from at2""",
    "build_traversals": f"""with recursive {_PLACED}, {S.CROSS}{S.origins_sql(_BUILD)}{S.SEEDS}, e as (select area_id, origin, radius_m, list((id, d0) order by id) as s from (select distinct area_id, lat || '|' || lon as origin, radius_m from rq) join sd using (area_id, origin) where radius_m - d0 >= 1 group by all)
select area_id, origin, max(radius_m) as max_m, count(*) as radii, cast(len(any_value(s)) as bigint) as seeds from e group by area_id, origin, s""",
    "build_variants": f"{_BUILT} select split_part(request_id, '|', 1) as polygon_key, split_part(request_id, ':', -3) as type, count(*) as asked, count(*) filter (request_id in (select request_id from sol)) as built, count(*) filter (request_id not in (select request_id from sol)) as empty from bw group by 1, 2",
    "build_outputs": f"""{_BUILT}, fs as (select * from (values ('tram', [300, 350, 400, 450, 500, 550]), ('train', [400, 450, 500, 550, 600, 650]), ('bus', [200, 250, 300, 350, 400, 450])) t(type, rs)), ft as (select type, unnest(rs) as r from fs)
select ft.type, cast(r as double) as radius_m, 'walksheds-' || ft.type || '-' || r || '.json' as filename, count(b.request_id) as polygons from ft left join (select *, split_part(request_id, ':', -3) as type from bw semi join sol using (request_id)) b on b.type = ft.type and b.radius_m = r group by ft.type, r""",
    "codec_circles": f"""{_RING}, d as (select *, qa - coalesce(lag(qa) over w, 0) as da, qo - coalesce(lag(qo) over w, 0) as do_ from p window w as (partition by id, type, lat, lon order by i))
select id, type, lat, lon, cast(i * 2 as integer) as pos, da as value from d union all select id, type, lat, lon, cast(i * 2 + 1 as integer), do_ from d""",
    "codec_round_trip": f"{_RING} select id, type, lat, lon, count(*) * 2 as numbers, bool_and(abs(qa) <= 9000000 and abs(qo) <= 18000000) as valid, true as close from p group by id, type, lat, lon",
    "scalar_radius": "select text, case when regexp_full_match(trim(text), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') then least(2000e0, greatest(100e0, floor(cast(trim(text) as double) / 50 + 0.5) * 50)) else 300e0 end as radius_m from (values "
    + ", ".join(f"('{t}')" for t in RADIUS_TEXTS) + ") t(text)",
    "scalar_wait": "select text, case when regexp_full_match(trim(text), '\\d+(\\.\\d+)?') then cast(trim(text) as double) * 1000 when text like '%GMT' then greatest(0e0, epoch_ms(strptime(text, '%a, %d %b %Y %H:%M:%S GMT')) - 1738800000000) end as wait_ms from (values "
    + ", ".join(f"('{t}')" for t in WAIT_TEXTS) + ") t(text)",
    "http_order": f"""with {ATTEMPTS}, o as (select * from at2 where endpoint is not null), l as (
  select endpoint, list(greatest(1e0, floor(coalesce(duration_ms, 0) + 0.5)) order by record_id, attempt_no) filter (outcome = 'ok') as xs from o group by 1
), k as (select endpoint, count(*) as tail from o p where (record_id, attempt_no) > coalesce((select max((record_id, attempt_no)) from o q where q.endpoint = p.endpoint and q.outcome = 'ok'), (-1, -1)) group by 1
), s as (select l.endpoint, coalesce(cast(list_reduce(xs, lambda a, b: floor(a * 0.75e0 + b * 0.25e0 + 0.5)) as bigint), 700) + least(6, coalesce(tail, 0)) * 1500
    - case when l.endpoint = (select arg_max(endpoint, (record_id, attempt_no)) from o where outcome = 'ok') then 120 else 0 end as score from l left join k using (endpoint))
select endpoint, cast(score as bigint) as score, cast(row_number() over (order by score, endpoint) as integer) as rank from s""",
}
