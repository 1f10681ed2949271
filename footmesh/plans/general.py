"""Queries of the general problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footmesh.operators.nested import network_rows
from footmesh.operators.proximity import near_pairs, points_in_regions
from footmesh.operators.snapshots import snapshot_changes
from footmesh.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = snapshot_changes(table(spark, sf_dir, "stop_snapshots"), "snapshot_no", "id", "lat", "lon", "loaded_at")
    return out.select(F.col("key").alias("id"), F.col("snap_no").alias("snapshot_no"), "change_kind")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network_rows(table(spark, sf_dir, "network_responses"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(table(spark, sf_dir, "stops"), "id", "lat", "lon", 150.0)


def p5_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops in the boxes that the requests of each area span, whatever their size.

    A box takes the shortest arc of longitudes that holds the area's requests, so it may lie over the
    180th meridian.
    """
    asked = table(spark, sf_dir, "requests").where("lat is not null and not isnan(lat) and lon is not null and not isnan(lon)").select("area_id", "lat", "lon")
    box = asked.groupBy("area_id").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e")).where("s < n and w < e")
    # only where the longitudes span half the globe can the way over the meridian be shorter
    lons = asked.join(box.where("e - w between 180 and 360"), "area_id").select("area_id", "lon", (360 - (F.col("e") - F.col("w"))).alias("outside")).distinct()
    gaps = lons.withColumn("to", F.lead("lon").over(W.partitionBy("area_id").orderBy("lon"))).where("to - lon > outside")
    over = gaps.groupBy("area_id").agg(F.max(F.struct((F.col("to") - F.col("lon")).alias("gap"), F.col("to").alias("w"), F.col("lon").alias("e"))).alias("m")).select("area_id", F.col("m.w").alias("ow"), F.col("m.e").alias("oe"))
    side = lambda w, e: F.struct(w.alias("w"), e.alias("e"))
    # a box over the meridian is given from either side, each time with its own end exact
    sides = F.when(F.col("ow").isNull(), F.array(side(F.col("w"), F.col("e")))).otherwise(F.array(side(F.col("ow"), F.col("oe") + 360), side(F.col("ow") - 360, F.col("oe"))))
    box = box.join(over, "area_id", "left").select("area_id", "s", "n", F.explode(sides).alias("x")).select("area_id", "s", "n", "x.w", "x.e")
    corner = lambda la, lo: F.struct(F.col(la).alias("lat"), F.col(lo).alias("lon"))
    rings = box.select("area_id", F.array(corner("s", "w"), corner("s", "e"), corner("n", "e"), corner("n", "w")).alias("ring"))
    return points_in_regions(table(spark, sf_dir, "stops"), "id", "lat", "lon", rings, "area_id", "ring")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p5_found": p5_found, "p5_region": p5_region}

HAVERSINE = "2*6371000e0*asin(sqrt(pow(sin((radians({2})-radians({0}))/2),2)+cos(radians({0}))*cos(radians({2}))*pow(sin((radians({3})-radians({1}))/2),2)))"


def haversine_sql(*cols: str) -> str:
    return HAVERSINE.format(*cols)


SQL = {
    "p1_found": f"""
with r as (
  select snapshot_no as n, lower(trim(regexp_replace(id, '^\\s+|\\s+$', '', 'g'))) as id, lat, lon, loaded_at from stop_snapshots
), l as (
  select n, id, case when isnan(lat) then null else lat end as lat, case when isnan(lon) then null else lon end as lon from r
  where id <> '' and n is not null
  qualify row_number() over (partition by n, id order by loaded_at desc nulls last, lat desc nulls last, lon desc nulls last) = 1
), e as (select min(n) as lo, max(n) as hi from l)
select coalesce(c.id, p.id) as id, cast(coalesce(c.n, p.n + 1) as integer) as snapshot_no,
  case when p.id is null then 'added' when c.id is null then 'removed' else 'changed' end as change_kind
from l c full join l p on c.id = p.id and c.n = p.n + 1, e
where coalesce(c.n, p.n + 1) > e.lo and coalesce(c.n, p.n + 1) <= e.hi
  and (p.id is null or c.id is null or ((c.lat is null or c.lon is null) <> (p.lat is null or p.lon is null))
    or coalesce({haversine_sql("p.lat", "p.lon", "c.lat", "c.lon")} > 2, false))""",
    "p2_found": """
with docs as (
  select record_id, case when json_type(j) = 'VARCHAR' then (j ->> '$')::json else j end as j from (
    select record_id, try_cast(regexp_replace(body, '^[﻿\\s]+', '') as json) as j, received_at from network_responses
    where record_id is not null and length(body) > 0)
  where j is not null
  qualify row_number() over (partition by record_id order by received_at) = 1
), att as (
  select record_id, a.i - 1 as attempt_no, a.v as v from docs, lateral (
    select unnest(range(1, len(l) + 1)) as i, unnest(l) as v from (
      select case json_type(j, '$.attempts') when 'ARRAY' then json_extract(j, '$.attempts[*]') else [json_extract(j, '$.attempts')] end as l)) a
), el as (
  select record_id, attempt_no, e.i - 1 as elem_ord, e.v as v from att, lateral (
    select unnest(range(1, len(l) + 1)) as i, unnest(l) as v from (
      select case json_type(v, '$.response.elements') when 'ARRAY' then json_extract(v, '$.response.elements[*]') else [json_extract(v, '$.response.elements')] end as l)) e
), ok as (
  select *, v ->> '$.type' as kind, v ->> '$.id' as eid from el
  where (v ->> '$.type') in ('node', 'way') and (v ->> '$.id') is not null
), refs as (
  select record_id, attempt_no, elem_ord, i - 1 as p, x ->> '$' as x from (
    select record_id, attempt_no, elem_ord, unnest(range(1, len(l) + 1)) as i, unnest(l) as x from (
      select *, case json_type(v, '$.nodes') when 'ARRAY' then json_extract(v, '$.nodes[*]') else [json_extract(v, '$.nodes')] end as l from ok))
), geo as (
  select record_id, attempt_no, elem_ord, i - 1 as p, x ->> '$' as x from (
    select record_id, attempt_no, elem_ord, unnest(range(1, len(l) + 1)) as i, unnest(l) as x from (
      select *, case json_type(v, '$.geometry') when 'ARRAY' then json_extract(v, '$.geometry[*]') else [json_extract(v, '$.geometry')] end as l from ok))
), tags as (
  select record_id, attempt_no, elem_ord, t.key as k, t.value ->> '$' as x from ok, json_each(v, '$.tags') t where json_type(v, '$.tags') = 'OBJECT'
  union all
  select record_id, attempt_no, elem_ord, t.value ->> '$.k', t.value ->> '$.v' from ok, json_each(v, '$.tags') t where json_type(v, '$.tags') = 'ARRAY'
)
select record_id, cast(attempt_no as integer) as attempt_no, cast(elem_ord as integer) as elem_ord, child_kind, child_key from (
  select record_id, attempt_no, elem_ord, kind as child_kind, cast(cast(eid as bigint) as varchar) as child_key from ok
  union all select record_id, attempt_no, elem_ord, 'ref', p || ':' || cast(x as bigint) from refs where x is not null
  union all select record_id, attempt_no, elem_ord, 'geom', cast(p as varchar) from geo where x is not null
  union all select distinct record_id, attempt_no, elem_ord, 'tag', k from tags where x is not null)""",
    "p5_found": f"""
with s as (select distinct id, lat, lon from stops where id is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and not (lat = 0 and lon = 0))
select distinct a.id as id_a, b.id as id_b from s a join s b on a.id < b.id and abs(a.lat - b.lat) < 0.01 and {haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")} <= 150""",
    "p5_region": """
with s as (select distinct id, lat, lon from stops where id is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and not (lat = 0 and lon = 0)),
q as (select area_id, lat, lon from requests where lat is not null and not isnan(lat) and lon is not null and not isnan(lon)),
b as (select area_id, min(lat) as s, max(lat) as n, min(lon) as w, max(lon) as e from q group by area_id having min(lat) < max(lat) and min(lon) < max(lon)),
g as (select area_id, lon, lead(lon) over (partition by area_id order by lon) as nxt from (select distinct area_id, lon from q)),
o as (select area_id, arg_max(nxt, (nxt - lon, nxt, lon)) as ow, arg_max(lon, (nxt - lon, nxt, lon)) as oe, max(nxt - lon) as gap from g where nxt is not null group by 1),
x as (select b.*, ow, oe, e - w between 180 and 360 and gap > 360 - (e - w) as over from b left join o using (area_id))
select distinct id, area_id as region_id from s join x on lat >= x.s and lat < x.n and case when over then lon >= ow or lon < oe else lon >= w and lon < e end""",
}
