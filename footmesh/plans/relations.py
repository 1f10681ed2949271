"""Relational queries around the network: stops, areas, batches, logs and caches, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footmesh.functions import codec, scalars
from footmesh.operators import folds, stops
from footmesh.plans import netsql as S
from footmesh.runtime import table


def stop_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops.stop_snapshot(table(spark, sf_dir, "stops"))


def stop_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_valid(spark, sf_dir).unionByName(stops.custom_stops(table(spark, sf_dir, "custom_stops")))


def stop_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops.drop_near_duplicates(stop_valid(spark, sf_dir), F.col("is_custom").isNull()).select("id", "name", "lat", "lon", "type")


def stop_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_valid(spark, sf_dir).groupBy("type").agg(F.count("*").alias("stops"), F.first(stops.default_radius(F.col("type"))).alias("radius_m"))


def stop_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops.stop_batches(stop_valid(spark, sf_dir)).select("id", "lat", "lon", "type", "cell_lat", "cell_lon", "batch_no")


def batch_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stops.query_areas(stop_batches(spark, sf_dir), ["cell_lat", "cell_lon", "batch_no"], stops.default_radius(F.col("type")))
    return rows.select("cell_lat", "cell_lon", "batch_no", "bucket_m", "area_key", *(F.round(c, 7).alias(c) for c in ("south", "west", "north", "east")), F.round("area_m2", 2).alias("area_m2"))


def stop_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_valid(spark, sf_dir).where(stops.in_view(F.col("lat"), F.col("lon"), 46.3, 6.4, 46.5, 6.8)).select("id", "lat", "lon")


def stop_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten stops next to the view's centre: a top-k report."""
    rows = stop_valid(spark, sf_dir).withColumn("score", stops.centre_score(F.col("lat"), F.col("lon"), 46.4, 6.6))
    return rows.orderBy("score", "id", "type").limit(10).select("id", "type", F.round(F.col("score") * 1e6, 6).alias("score"))


def stop_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops of the visible types without the disabled ones; as disabled count the stops that were asked for without a radius."""
    shown = spark.createDataFrame([("tram", True), ("train", True), ("bus", False)], "type string, visible boolean")
    off = table(spark, sf_dir, "requests").where("radius_m is null and stop_id is not null").select(F.trim("stop_id").alias("id")).distinct()
    return stop_valid(spark, sf_dir).join(F.broadcast(shown.where("visible")), "type").join(off, "id", "left_anti").select("id", "type", "lat", "lon")


def stop_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stop_valid(spark, sf_dir).select("id", "type", F.posexplode(scalars.circle(F.col("lat"), F.col("lon"), stops.default_radius(F.col("type")))).alias("pos", "p"), "lat", "lon")
    return rows.groupBy("id", "type", "lat", "lon").agg(F.count("*").alias("vertices"), F.round(F.max("p.lat"), 7).alias("north"), F.round(F.min("p.lat"), 7).alias("south"), F.round(F.max("p.lon"), 7).alias("east"), F.round(F.min("p.lon"), 7).alias("west"))


def stop_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stop_valid(spark, sf_dir).withColumn("polygon_key", codec.polygon_key(F.col("id"), F.col("type"), F.col("lat"), F.col("lon")))
    return rows.select("polygon_key", codec.type_of_key(F.col("polygon_key")).alias("key_type"), codec.result_key(F.col("id"), "crossings", stops.default_radius(F.col("type")), F.col("lat"), F.col("lon")).alias("result_key"))


def request_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "requests").select("request_id", scalars.clamp_radius(F.col("radius_m"), F.lit(300.0)).alias("radius_m"), scalars.radius_bucket(scalars.clamp_radius(F.col("radius_m"), F.lit(300.0))).alias("bucket_m"))


def request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "requests").distinct()
    return rows.groupBy("area_id").agg(F.count("*").alias("total"), F.count_if(F.col("stop_id").isNull()).alias("without_stop"), F.count_if(F.col("radius_m").isNull()).alias("without_radius"), F.count_if(F.expr("received_at > requested_at + interval 1 hour")).alias("late"))


def request_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.debounce(table(spark, sf_dir, "requests").distinct(), "area_id", "requested_at", "2 hours")


def cache_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "requests").select(F.col("request_id").alias("key"), F.when(F.col("radius_m").isNull(), "unavailable").otherwise("polygon").alias("kind"), F.col("requested_at").alias("updated_at")).distinct()
    return folds.prune_cache(rows, F.lit("2025-02-20 00:00:00").cast("timestamp_ntz"))


def cache_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a small cache of each area evicts as its stops are asked for."""
    rows = table(spark, sf_dir, "requests").distinct()
    return folds.weighted_lru(rows, "area_id", ["requested_at", "request_id"], "stop_id", "radius_m", 12, 3000.0)


def http_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folds.attempts(table(spark, sf_dir, "network_responses"))
    return rows.groupBy("endpoint", "outcome").agg(F.count("*").alias("attempts"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"), F.floor(F.avg("duration_ms") + 0.5).cast("bigint").alias("average_ms"), F.count("status").alias("with_status"))


def http_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folds.attempts(table(spark, sf_dir, "network_responses"))
    stats = folds.smoothed_latency(rows, "endpoint", ["record_id", "attempt_no"], "duration_ms", F.col("outcome") == "ok")
    return folds.endpoint_ranks(stats).select("endpoint", "latency_ms", "failure_streak", "successes", "score", "rank")


QUERIES = {
    f.__name__: f for f in (stop_valid, stop_all, stop_dedup, stop_types, stop_batches, batch_areas, stop_in_view, stop_nearest, stop_visible, stop_circles, stop_keys, request_radius, request_counts, request_bursts, cache_kept, cache_evictions, http_metrics, http_endpoints)
}

VALID = """sv as (select distinct id, name, lat, lon, type, is_custom from stops where id is not null and name is not null and lat is not null and lon is not null and isfinite(lat) and isfinite(lon)
  and type in ('tram', 'train', 'bus') and not coalesce(is_custom, false))"""
RADIUS = "case type when 'tram' then 300e0 when 'train' then 400e0 when 'bus' then 200e0 end"
BATCHES = f"""{VALID}, sb as (
  select *, (row_number() over (partition by cell_lat, cell_lon order by right(id, 2), id, lat, lon, type) - 1) // 48 as batch_no from (
    select *, cast(floor(lat / 0.01e0) as bigint) as cell_lat, cast(floor(lon / 0.015e0) as bigint) as cell_lon from sv))"""
CLAMP = "case when radius_m is null or isnan(radius_m) or isinf(radius_m) then 300e0 else least(2000e0, greatest(100e0, floor(radius_m / 50 + 0.5) * 50)) end"
BUCKET = "case when {0} <= 300 then 300e0 when {0} <= 600 then 600e0 when {0} <= 1200 then 1200e0 when {0} <= 2400 then 2400e0 when {0} <= 5000 then 5000e0 else greatest({0}, 5000e0) end"
NUM = "regexp_replace(cast({0} as varchar), '\\.0$', '')"
ATTEMPTS = S.ELEMENTS.split("), el as (")[0] + "), at2 as (select record_id, attempt_no, v ->> '$.endpoint' as endpoint, try_cast(v ->> '$.duration_ms' as bigint) as duration_ms, v ->> '$.outcome' as outcome, try_cast(v ->> '$.status' as integer) as status from att where json_type(v) = 'OBJECT')"

SQL = {
    "stop_valid": f"with {VALID} select * from sv",
    "stop_all": f"""with {VALID} select * from sv union all select distinct id, name, lat, lon, case when type in ('tram', 'train', 'bus') then type else 'tram' end as type, true as is_custom from custom_stops
where id is not null and name is not null and lat is not null and lon is not null and isfinite(lat) and isfinite(lon)""",
    "stop_dedup": f"""with {VALID} select id, name, lat, lon, type from sv s where is_custom is not null or not exists (
  select 1 from sv o where o.is_custom is not null and o.name = s.name and sqrt(pow((s.lat - o.lat) * 111320e0, 2) + pow((s.lon - o.lon) * 111320e0 * cos(radians((s.lat + o.lat) / 2)), 2)) <= 150)""",
    "stop_types": f"with {VALID} select type, count(*) as stops, {RADIUS} as radius_m from sv group by type",
    "stop_batches": f"with {BATCHES} select id, lat, lon, type, cell_lat, cell_lon, batch_no from sb",
    "batch_areas": f"""with {BATCHES}, g as (
  select cell_lat, cell_lon, batch_no, {BUCKET.format(f"max({RADIUS})")} as bucket_m, floor(min(lat) * 1000) / 1000 as s, floor(min(lon) * 1000) / 1000 as w, ceil(max(lat) * 1000) / 1000 as n, ceil(max(lon) * 1000) / 1000 as e from sb group by 1, 2, 3
), p as (select *, s - (bucket_m + 80) / 111320e0 as south, n + (bucket_m + 80) / 111320e0 as north from g
), q as (select *, (bucket_m + 80) / (111320e0 * greatest(0.2e0, cos(radians(greatest(abs(south), abs(north)))))) as d from p)
select cell_lat, cell_lon, batch_no, bucket_m, format('{{:.3f}}:{{:.3f}}:{{:.3f}}:{{:.3f}}:{{}}', s, w, n, e, cast(bucket_m as bigint)) as area_key, round(south, 7) as south, round(w - d, 7) as west, round(north, 7) as north, round(e + d, 7) as east,
  round(greatest(0e0, north - south) * 111320e0 * greatest(0e0, (e + d) - (w - d)) * (111320e0 * greatest(0.2e0, cos(radians((south + north) / 2)))), 2) as area_m2 from q""",
    "stop_in_view": f"with {VALID} select id, lat, lon from sv where lat between 46.3e0 - (46.5e0 - 46.3e0) * 0.08e0 and 46.5e0 + (46.5e0 - 46.3e0) * 0.08e0 and lon between 6.4e0 - (6.8e0 - 6.4e0) * 0.08e0 and 6.8e0 + (6.8e0 - 6.4e0) * 0.08e0",
    "stop_nearest": f"with {VALID}, c as (select id, type, pow(lat - 46.4e0, 2) + pow((lon - 6.6e0) * cos(radians(46.4e0)), 2) as score from sv) select id, type, round(score * 1e6, 6) as score from c order by c.score, id, type limit 10",
    "stop_visible": f"with {VALID} select id, type, lat, lon from sv where type in ('tram', 'train') and id not in (select trim(stop_id) from requests where radius_m is null and stop_id is not null)",
    "stop_circles": f"""with {VALID}, a as (select *, ({RADIUS}) / 6371008.8e0 as ang, radians(lat) as phi, unnest(range(0, 65)) as i from sv
), y as (select *, i * (2 * 3.141592653589793e0 / 64) as b from a), z as (select *, asin(sin(phi) * cos(ang) + cos(phi) * sin(ang) * cos(b)) as y from y
), p as (select id, type, lat, lon, degrees(y) as py, degrees(radians(lon) + atan2(sin(b) * sin(ang) * cos(phi), cos(ang) - sin(phi) * sin(y))) as px from z)
select id, type, lat, lon, count(*) as vertices, round(max(py), 7) as north, round(min(py), 7) as south, round(max(px), 7) as east, round(min(px), 7) as west from p group by 1, 2, 3, 4""",
    "stop_keys": f"""with {VALID} select id || ':' || type || ':' || {NUM.format("lat")} || ':' || {NUM.format("lon")} as polygon_key, type as key_type,
  id || ':v2:crossings:' || cast(cast({RADIUS} as bigint) as varchar) || ':' || format('{{:.6f}}', lat) || ':' || format('{{:.6f}}', lon) as result_key from sv""",
    "request_radius": f"select request_id, {CLAMP} as radius_m, {BUCKET.format(CLAMP)} as bucket_m from requests",
    "request_counts": "select area_id, count(*) as total, count(*) filter (stop_id is null) as without_stop, count(*) filter (radius_m is null) as without_radius, count(*) filter (received_at > requested_at + interval 1 hour) as late from (select distinct * from requests) group by 1",
    "request_bursts": """with d as (select distinct * from requests where area_id is not null and requested_at is not null), g as (
  select *, case when requested_at < lag(requested_at) over w + interval 2 hour then 0 else 1 end as fresh from d window w as (partition by area_id order by requested_at)
), s as (select *, sum(fresh) over (partition by area_id order by requested_at rows unbounded preceding) as burst from g)
select area_id, min(requested_at) as first_at, max(requested_at) as last_at, count(*) as n from s group by area_id, burst""",
    "cache_kept": """with c as (select distinct request_id as key, case when radius_m is null then 'unavailable' else 'polygon' end as kind, requested_at as updated_at from requests where requested_at >= timestamp '2025-01-21 00:00:00'
), r as (select *, row_number() over (partition by kind order by updated_at desc, key) as rn, count(*) filter (kind = 'polygon') over () as polygons from c)
select key, kind, updated_at from r where (kind = 'polygon' and rn <= 4000) or (kind <> 'polygon' and rn <= least(1000, greatest(0, 4000 - least(polygons, 4000))))""",
    "http_metrics": f"with {ATTEMPTS} select endpoint, outcome, count(*) as attempts, cast(sum(duration_ms) as bigint) as total_ms, max(duration_ms) as max_ms, cast(floor(avg(duration_ms) + 0.5) as bigint) as average_ms, count(status) as with_status from at2 group by 1, 2",
    "http_endpoints": f"""with {ATTEMPTS}, o as (select * from at2 where endpoint is not null), l as (
  select endpoint, list(greatest(1e0, floor(coalesce(duration_ms, 0) + 0.5)) order by record_id, attempt_no) filter (outcome = 'ok') as xs, count(*) filter (outcome = 'ok') as successes from o group by 1
), k as (select endpoint, count(*) as tail from o p where (record_id, attempt_no) > coalesce((select max((record_id, attempt_no)) from o q where q.endpoint = p.endpoint and q.outcome = 'ok'), (-1, -1)) group by 1
), t as (select l.endpoint, cast(list_reduce(xs, lambda a, b: floor(a * 0.75e0 + b * 0.25e0 + 0.5)) as bigint) as latency_ms, cast(least(6, coalesce(tail, 0)) as bigint) as failure_streak, successes from l left join k using (endpoint))
select *, latency_ms + failure_streak * 1500 as score, cast(row_number() over (order by latency_ms + failure_streak * 1500, endpoint) as integer) as rank from t""",
    "cache_evictions": """with recursive rw as (select *, row_number() over (partition by area_id order by requested_at, request_id, stop_id) - 1 as no from (select distinct * from requests) where area_id is not null and stop_id is not null
), st as (
  select area_id, cast(-1 as bigint) as no, cast([] as struct(k varchar, w double)[]) as held, cast([] as varchar[]) as gone from rw group by 1
  union all
  select area_id, no, list_slice(h, cut + 1, len(h)), list_transform(list_slice(h, 1, cut), lambda x: x.k) from (
    select *, coalesce(list_filter(range(0, len(h)), lambda m: len(h) - m <= 12 and (len(h) - m <= 1 or list_sum(list_transform(list_slice(h, m + 1, len(h)), lambda x: x.w)) <= 3000))[1], len(h) - 1) as cut from (
      select rw.area_id, rw.no, list_append(list_filter(st.held, lambda x: x.k <> rw.stop_id), struct_pack(k := rw.stop_id, w := coalesce(rw.radius_m, 0e0))) as h
      from st join rw on rw.area_id = st.area_id and rw.no = st.no + 1)))
select area_id, unnest(gone) as stop_id, no as evicted_at from st""",
}
