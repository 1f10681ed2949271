"""SQL for the network queries: common parts, as text that DuckDB runs."""

HAV = "2*6371000e0*asin(sqrt(pow(sin((radians({2})-radians({0}))/2),2)+cos(radians({0}))*cos(radians({2}))*pow(sin((radians({3})-radians({1}))/2),2)))"


def hav(*c: str) -> str:
    return HAV.format(*c)


ELEMENTS = """
docs as (
  select record_id, j, j ->> '$.batch.area_id' as area_id from (
    select record_id, case when json_type(j) = 'VARCHAR' then (j ->> '$')::json else j end as j, received_at from (
      select record_id, try_cast(regexp_replace(body, '^[﻿\\s]+', '') as json) as j, received_at from network_responses
      where record_id is not null and length(body) > 0))
  where j is not null
  qualify row_number() over (partition by record_id order by received_at) = 1
), att as (
  select record_id, area_id, a.i - 1 as attempt_no, a.v as v from docs, lateral (
    select unnest(range(1, len(l) + 1)) as i, unnest(l) as v from (
      select case json_type(j, '$.attempts') when 'ARRAY' then json_extract(j, '$.attempts[*]') else [json_extract(j, '$.attempts')] end as l)) a
), el as (
  select record_id, area_id, attempt_no, e.i - 1 as elem_ord, e.v as v from att, lateral (
    select unnest(range(1, len(l) + 1)) as i, unnest(l) as v from (
      select case json_type(v, '$.response.elements') when 'ARRAY' then json_extract(v, '$.response.elements[*]') else [json_extract(v, '$.response.elements')] end as l)) e
), ok as materialized (
  select record_id, area_id, attempt_no, elem_ord, v, v ->> '$.type' as kind, try_cast(v ->> '$.id' as bigint) as id from el
  where (v ->> '$.type') in ('node', 'way') and try_cast(v ->> '$.id' as bigint) is not null and area_id is not null
), tags as (
  select record_id, attempt_no, elem_ord, t.key as k, t.value ->> '$' as x from ok, json_each(v, '$.tags') t where kind = 'way' and json_type(v, '$.tags') = 'OBJECT'
  union all
  select record_id, attempt_no, elem_ord, t.value ->> '$.k', t.value ->> '$.v' from ok, json_each(v, '$.tags') t where kind = 'way' and json_type(v, '$.tags') = 'ARRAY'
), nd as materialized (
  select area_id, id, lat, lon from (
    select *, try_cast(v ->> '$.lat' as double) as lat, try_cast(v ->> '$.lon' as double) as lon from ok where kind = 'node')
  where lat is not null and lon is not null
  qualify row_number() over (partition by area_id, id order by record_id desc, attempt_no desc, elem_ord desc) = 1
), wt as (
  select record_id, attempt_no, elem_ord, max(x) filter (k = 'highway') as highway, max(x) filter (k = 'area') as area, max(x) filter (k = 'indoor') as indoor,
    max(x) filter (k = 'access') as access, max(x) filter (k = 'foot') as foot from tags group by all
), wy as materialized (
  select ok.area_id, ok.record_id, ok.attempt_no, ok.elem_ord, ok.id, ok.v, highway from ok join wt using (record_id, attempt_no, elem_ord)
  where ok.kind = 'way' and highway is not null
    and not regexp_matches(highway, 'motorway|motorway_link|trunk|trunk_link|construction|proposed|bus_guideway|raceway|bridleway|corridor|escape')
    and coalesce(wt.area <> 'yes', true) and coalesce(indoor <> 'yes', true)
    and coalesce(not regexp_matches(access, 'private|no'), true) and coalesce(not regexp_matches(foot, 'no'), true)
), refs as materialized (
  select area_id, record_id, attempt_no, elem_ord, highway, i - 1 as pos, try_cast(x ->> '$' as bigint) as id from (
    select *, unnest(range(1, len(l) + 1)) as i, unnest(l) as x from (
      select *, case json_type(v, '$.nodes') when 'ARRAY' then json_extract(v, '$.nodes[*]') else [json_extract(v, '$.nodes')] end as l from wy))
)"""

GRAPH = (
    ELEMENTS
    + """, seen as (
  select area_id, id, min(struct_pack(record_id := record_id, attempt_no := attempt_no, elem_ord := elem_ord, pos := pos)) as seen from refs where id is not null group by all
), gn as materialized (select area_id, id, lat, lon, seen from seen join nd using (area_id, id)
), pr as (
  select area_id, record_id, attempt_no, elem_ord, highway, pos, id as a, lead(id) over w as b, lead(pos) over w as npos from refs
  window w as (partition by record_id, attempt_no, elem_ord order by pos)
), e0 as (
  select area_id, least(a, b) as u, greatest(a, b) as v,
    arg_min(highway in ('primary', 'secondary', 'tertiary', 'residential', 'unclassified', 'service', 'living_street'), struct_pack(r := record_id, t := attempt_no, e := elem_ord, p := pos)) as is_road
  from pr where a <> b group by 1, 2, 3
), eg as materialized (
  select * from (
    select e0.area_id, u, v, is_road, a.lat as u_lat, a.lon as u_lon, b.lat as v_lat, b.lon as v_lon, """
    + hav("a.lat", "a.lon", "b.lat", "b.lon")
    + """ as w
    from e0 join gn a on a.area_id = e0.area_id and a.id = u join gn b on b.area_id = e0.area_id and b.id = v) where w > 0
)"""
)

CROSS = (
    GRAPH
    + """, sc as (select area_id, greatest(0.2e0, cos(radians(arg_min(lat, seen)))) as scale from gn group by 1
), rd as (select area_id, u as id from eg where is_road union select area_id, v from eg where is_road
), offr as (select gn.*, scale, cast(floor(lat / (30e0 / 111320e0)) as bigint) as cy, cast(floor(lon * scale / (30e0 / 111320e0)) as bigint) as cx from gn join sc using (area_id) anti join rd using (area_id, id)
), cp as (
  select a.area_id, a.id as a, b.id as b, a.lat as a_lat, a.lon as a_lon, b.lat as b_lat, b.lon as b_lon, b.cy - a.cy as dy, b.cx - a.cx as dx, b.seen as b_seen, a.scale, """
    + hav("a.lat", "a.lon", "b.lat", "b.lon")
    + """ as w
  from offr a join offr b on a.area_id = b.area_id and abs(a.cy - b.cy) <= 1 and abs(a.cx - b.cx) <= 1 and b.seen > a.seen
), cg as (
  select cp.area_id, cp.a, cp.b, cp.w, dy, dx, b_seen from cp join eg r on r.area_id = cp.area_id and r.is_road
  where cp.w between 3 and 30
    and ((b_lon - a_lon) * (u_lat - a_lat) - (b_lat - a_lat) * (u_lon - a_lon)) * ((b_lon - a_lon) * (v_lat - a_lat) - (b_lat - a_lat) * (v_lon - a_lon)) < 0
    and ((v_lon - u_lon) * (a_lat - u_lat) - (v_lat - u_lat) * (a_lon - u_lon)) * ((v_lon - u_lon) * (b_lat - u_lat) - (v_lat - u_lat) * (b_lon - u_lon)) < 0
    and abs(((b_lon - a_lon) * greatest(0.2e0, cos(radians((a_lat + b_lat) / 2))) * (v_lon - u_lon) * greatest(0.2e0, cos(radians((a_lat + b_lat) / 2))) + (b_lat - a_lat) * (v_lat - u_lat))
      / (sqrt(pow((b_lon - a_lon) * greatest(0.2e0, cos(radians((a_lat + b_lat) / 2))), 2) + pow(b_lat - a_lat, 2)) * sqrt(pow((v_lon - u_lon) * greatest(0.2e0, cos(radians((a_lat + b_lat) / 2))), 2) + pow(v_lat - u_lat, 2)))) <= 0.5
), cb as (select area_id, a, arg_min(b, struct_pack(w := w, dy := dy, dx := dx, s := b_seen)) as b, min(w) as w from cg group by 1, 2
), cx as materialized (select distinct area_id, least(a, b) as u, greatest(a, b) as v, w from cb anti join eg on eg.area_id = cb.area_id and eg.u = least(a, b) and eg.v = greatest(a, b)
), ex as materialized (
  select area_id, u, v, w, u_lat, u_lon, v_lat, v_lon from eg
  union all select cx.area_id, u, v, w, p.lat, p.lon, q.lat, q.lon from cx join gn p on p.area_id = cx.area_id and p.id = u join gn q on q.area_id = cx.area_id and q.id = v
)"""
)

CLAMP = "case when radius_m is null or isnan(radius_m) or isinf(radius_m) then 300e0 else least(2000e0, greatest(100e0, floor(radius_m / 50 + 0.5) * 50)) end"
ASKED = f"select distinct request_id, area_id, lat, lon, {CLAMP} as radius_m from requests"


def origins_sql(asked: str) -> str:
    """Distinct origins of what is asked in areas that have a network, and the largest radius asked of each."""
    return f""", rq as materialized (
  select * from ({asked}) where lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and area_id in (select area_id from gn)
), og as materialized (select area_id, lat || '|' || lon as origin, lat, lon, max(radius_m) as max_m from rq group by 1, 2, 3, 4
)"""


ORIGINS = origins_sql(ASKED)

COMPONENTS = """, both_ways as (select area_id, u as a, v as b from ex union all select area_id, v, u from ex
), cc(area_id, id, c) using key (area_id, id) as (
  select area_id, id, id from gn
  union
  select n.area_id, n.id, n.c from (select e.area_id, e.b as id, min(cc.c) as c from cc join both_ways e on e.area_id = cc.area_id and e.a = cc.id group by 1, 2) n
    join recurring.cc r on r.area_id = n.area_id and r.id = n.id where n.c < r.c
), cm as materialized (select area_id, id, c as component from cc
), cs as materialized (select area_id, component, count(*) as size, count(*) >= greatest(30, floor(max(count(*)) over (partition by area_id) * 0.1)) as substantial from cm group by 1, 2
)"""

_SNAP = """
  select * from (
    select o.area_id, o.origin, e.u, e.v, e.w, e.u_lat, e.u_lon, e.v_lat, e.v_lon, o.lat, o.lon, greatest(0.2e0, cos(radians(o.lat))) as k,
      case when pow((v_lon - u_lon), 2) + pow(v_lat - u_lat, 2) = 0 then 0 else greatest(0, least(1, -((u_lon - o.lon) * k * ((v_lon - o.lon) * k - (u_lon - o.lon) * k) + (u_lat - o.lat) * ((v_lat - o.lat) - (u_lat - o.lat)))
        / (pow((v_lon - o.lon) * k - (u_lon - o.lon) * k, 2) + pow((v_lat - o.lat) - (u_lat - o.lat), 2)))) end as t,
      {hav} as snap_m
    from {origins} o join {edges} e on e.area_id = o.area_id and least(u_lat, v_lat) <= o.lat + {pad} / 111000e0 and greatest(u_lat, v_lat) >= o.lat - {pad} / 111000e0 and least(u_lon, v_lon) <= o.lon + 0.1 and greatest(u_lon, v_lon) >= o.lon - 0.1)
  where snap_m <= {pad}
  qualify row_number() over (partition by area_id, origin order by round(snap_m, 9), least((u_lat, u_lon), (v_lat, v_lon)), greatest((u_lat, u_lon), (v_lat, v_lon)), u, v) = 1"""


def snap_sql(origins: str, edges: str, pad: str) -> str:
    return _SNAP.format(origins=origins, edges=edges, pad=pad, hav=hav("o.lat", "o.lon", "(u_lat + (v_lat - u_lat) * t)", "(u_lon + (v_lon - u_lon) * t)"))


SEEDS = (
    COMPONENTS
    + ", sn as materialized ("
    + snap_sql("og", "ex", "250e0")
    + "), bo as (select og.* from og join sn on sn.area_id = og.area_id and sn.origin = og.origin join cm on cm.area_id = sn.area_id and cm.id = sn.u join cs on cs.area_id = cm.area_id and cs.component = cm.component where not substantial"
    + "), be as (select ex.* from ex join cm on cm.area_id = ex.area_id and cm.id = ex.u join cs on cs.area_id = cm.area_id and cs.component = cm.component where substantial"
    + "), bs as materialized ("
    + snap_sql("bo", "be", "40e0")
    + """), sd as materialized (
  select area_id, origin, id, min(d0) as d0 from (
    select area_id, origin, u as id, snap_m + w * t as d0 from sn union all select area_id, origin, v, snap_m + w * (1 - t) from sn
    union all select area_id, origin, u, snap_m + w * t from bs union all select area_id, origin, v, snap_m + w * (1 - t) from bs) group by 1, 2, 3
)"""
)

PATHS = (
    SEEDS
    + """, arcs as materialized (select area_id, u as a, v as b, w from ex union all select area_id, v, u, w from ex
), sp(area_id, origin, id, d, max_m) using key (area_id, origin, id) as (
  select sd.area_id, sd.origin, id, d0, max_m from sd join og on og.area_id = sd.area_id and og.origin = sd.origin where d0 <= max_m
  union
  select n.area_id, n.origin, n.id, n.d, n.max_m from (
    select sp.area_id, sp.origin, arcs.b as id, min(sp.d + arcs.w) as d, max(sp.max_m) as max_m from sp join arcs on arcs.area_id = sp.area_id and arcs.a = sp.id where sp.d + arcs.w <= sp.max_m group by 1, 2, 3) n
    left join recurring.sp r on r.area_id = n.area_id and r.origin = n.origin and r.id = n.id where r.d is null or n.d < r.d
)"""
)
