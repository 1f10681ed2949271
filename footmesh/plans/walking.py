"""Queries of the walking network: from raw fetch records to polygons, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footmesh.functions import codec
from footmesh.functions.scalars import clamp_radius
from footmesh.operators import graph as G
from footmesh.operators.hull import hulls
from footmesh.plans import netsql as S
from footmesh.runtime import cut, table
from footmesh.sources import network as N


class Walk:
    """The stages of the pipeline over one set of tables, each made when first asked for and kept."""

    def __init__(self, spark: SparkSession, sf_dir: str, with_crossings: bool = True, wanted: DataFrame | None = None):
        """``wanted``: request_id, area_id, lat, lon, radius_m in place of the table of requests."""
        self.spark, self.dir, self.crossing, self.wanted = spark, sf_dir, with_crossings, wanted
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def network(self) -> tuple[DataFrame, DataFrame]:
        return self._once("network", lambda: N.load_network(table(self.spark, self.dir, "network_responses")))

    @property
    def graph(self) -> DataFrame:
        nodes, ways = self.network
        return self._once("graph", lambda: cut(G.graph_nodes(ways, nodes)))

    @property
    def way_edges(self) -> DataFrame:
        return self._once("way_edges", lambda: cut(G.way_edges(self.network[1], self.graph)))

    @property
    def edges(self) -> DataFrame:
        return self._once("edges", lambda: cut(G.with_crossings(self.graph, self.way_edges)) if self.crossing else self.way_edges)

    @property
    def components(self) -> DataFrame:
        return self._once("components", lambda: cut(G.components(self.graph, self.edges)))

    @property
    def asked(self) -> DataFrame:
        """request_id, area_id, origin, lat, lon, radius_m of every request, repeats once."""

        def make() -> DataFrame:
            rows = self.wanted
            if rows is None:
                rows = table(self.spark, self.dir, "requests").select("request_id", "area_id", "lat", "lon", clamp_radius(F.col("radius_m"), F.lit(300.0)).alias("radius_m")).distinct()
            return cut(rows.withColumn("origin", F.concat_ws("|", F.col("lat").cast("string"), F.col("lon").cast("string"))))

        return self._once("asked", make)

    @property
    def requests(self) -> DataFrame:
        """Those of ``asked`` that a search can serve: with a position, in areas that have a network."""

        def make() -> DataFrame:
            rows = self.asked.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
            return cut(rows.join(self.graph.select("area_id").distinct(), "area_id", "left_semi"))

        return self._once("requests", make)

    @property
    def origins(self) -> DataFrame:
        """One row an area and position, with the largest radius asked there: all radii share one search."""
        return self._once("origins", lambda: cut(self.requests.groupBy("area_id", "origin", "lat", "lon").agg(F.max("radius_m").alias("max_m"))))

    @property
    def seeds(self) -> DataFrame:
        return self._once("seeds", lambda: cut(G.seeds(self.origins.drop("max_m"), self.graph, self.edges, self.components)))

    @property
    def paths(self) -> DataFrame:
        return self._once("paths", lambda: cut(G.batched_paths(self.seeds, self.edges, self.origins.select("area_id", "origin", "max_m"), self.origins.drop("max_m"))))

    @property
    def boundary(self) -> DataFrame:
        asked = self.requests.select("area_id", "origin", "request_id", "radius_m")
        # a seed counts for a radius only with at least a metre left to walk
        usable = self.seeds.join(asked, ["area_id", "origin"]).where(F.col("radius_m") - F.col("d0") >= G.MIN_WALK_M).select("request_id").distinct()
        return self._once("boundary", lambda: cut(G.boundary_points(self.paths, self.graph, self.edges, asked.join(usable, "request_id"))))

    @property
    def local(self) -> DataFrame:
        centres = self.requests.select("request_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
        return self._once("local", lambda: cut(G.local_points(self.boundary, centres)))


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def net_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Walk(spark, sf_dir).network[0]


def net_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Walk(spark, sf_dir).network[1].select("area_id", "record_id", "attempt_no", "elem_ord", "id", "highway")


def net_recurse_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ways = Walk(spark, sf_dir).network
    return N.recurse_down(ways, nodes).select("area_id", "id")


def graph_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.node_index(Walk(spark, sf_dir).graph).select("area_id", "id", F.col("node_idx").cast("bigint").alias("node_idx"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Walk(spark, sf_dir).way_edges.select("area_id", "u", "v", *r6("w"), "is_road")


def graph_segment_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Walk(spark, sf_dir)
    return G.whole_segment_cells(w.way_edges, G.area_scale(w.graph))


def graph_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Walk(spark, sf_dir)
    return G.crossings(w.graph, w.way_edges).select("area_id", "u", "v", *r6("w"))


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Walk(spark, sf_dir)
    return w.components.join(G.component_sizes(w.components), ["area_id", "component"]).select("area_id", "id", "component", "size", "substantial")


def snap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Walk(spark, sf_dir)
    return G.nearest_edges(w.origins, w.edges, G.area_scale(w.graph), G.SNAP_M).select("area_id", "origin", *r6("snap_m"))


def snap_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Walk(spark, sf_dir).seeds.select("area_id", "origin", "id", *r6("d0"))


def walk_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Walk(spark, sf_dir).paths.select("area_id", "origin", "id", *r6("d"))


def walk_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary points of each request, counted before they are made distinct."""
    return Walk(spark, sf_dir).boundary.groupBy("request_id").agg(F.count("*").alias("points"), F.count_if("is_cut").alias("cuts"), F.round(F.max("lat"), 7).alias("lat"), F.round(F.max("lon"), 7).alias("lon"))


def walk_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: each request's polygon as ring points, or the reason why it has none.

    A request without a position or in an area without a network has no edge nearby.
    """
    w = Walk(spark, sf_dir)
    rings = cut(hulls(w.local))
    snapped = w.seeds.select("area_id", "origin").distinct().withColumn("near", F.lit(True))
    have = rings.select("request_id").distinct().withColumn("ring", F.lit(True))
    state = w.asked.join(snapped, ["area_id", "origin"], "left").join(have, "request_id", "left")
    reason = F.when(F.col("ring"), None).when(F.col("near"), "invalid-polygon").otherwise("no-nearby-edge")
    none = state.where("ring is null").select("request_id", reason.alias("reason"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    return none.unionByName(rings.withColumn("reason", F.lit(None).cast("string")))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, polygon of the requests that have one."""
    rings = hulls(Walk(spark, sf_dir).local)
    rows = rings.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("ring"))
    return rows.select("request_id", F.transform("ring", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("polygon"))


def walk_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons as delta-encoded integers, with the error of the round trip."""
    rows = cut(polygons(spark, sf_dir)).withColumn("encoded", codec.encode(F.col("polygon")))
    rows = rows.withColumn("back", codec.decode(F.col("encoded")))
    worst = F.array_max(F.zip_with("polygon", "back", lambda a, b: F.greatest(F.abs(a["lat"] - b["lat"]), F.abs(a["lon"] - b["lon"]))))
    return rows.select("request_id", F.size("encoded").alias("n_ints"), codec.valid_encoding(F.col("encoded")).alias("valid"), (worst <= 1e-5).alias("close"))


def walk_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One GeoJSON feature a polygon: closed ring, longitude first."""
    ring = F.transform("polygon", lambda p: F.array(p["lon"], p["lat"]))
    closed = F.concat(ring, F.slice(ring, 1, 1))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("request_id").alias("properties"), geometry.alias("geometry"))
    return polygons(spark, sf_dir).select("request_id", F.to_json(feature).alias("feature"))


def walk_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes each origin reaches at several radii, from one search to the largest of them."""
    w = Walk(spark, sf_dir)
    radii = [100.0, 200.0, 300.0]
    budget = w.origins.select("area_id", "origin", F.lit(max(radii)).alias("max_m"))
    paths = cut(G.batched_paths(w.seeds, w.edges, budget, w.origins.drop("max_m")))
    return reduce(DataFrame.unionByName, [paths.where(F.col("d") <= r).groupBy("area_id", "origin").agg(F.count("*").alias("nodes")).withColumn("radius_m", F.lit(r)) for r in radii])


def walk_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct points of each request on the centimetre grid of its plane, with their extent in centimetres."""
    cm = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("bigint")
    rows = Walk(spark, sf_dir).local.select("request_id", cm("x").alias("x"), cm("y").alias("y"))
    return rows.groupBy("request_id").agg(F.count("*").alias("points"), F.min("x").alias("west"), F.max("x").alias("east"), F.min("y").alias("south"), F.max("y").alias("north"))


def walk_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a request: whether it has a polygon, or why not."""
    return walk_polygons(spark, sf_dir).groupBy("request_id").agg(F.coalesce(F.max("reason"), F.lit("polygon")).alias("state"))


def walk_convex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corner counts of the convex hulls."""
    return hulls(Walk(spark, sf_dir).local, concave=False).groupBy("request_id").agg(F.count("*").alias("corners"))


QUERIES = {
    f.__name__: f for f in (net_nodes, net_ways, net_recurse_down, graph_index, graph_edges, graph_segment_cells, graph_crossings, graph_components, snap_edges, snap_seeds, walk_distances, walk_boundary, walk_polygons, walk_encoded, walk_geojson, walk_radii, walk_local, walk_states, walk_convex)
}

BOUNDARY = """, ux as (select distinct request_id, rq.area_id, rq.lat || '|' || rq.lon as origin, radius_m from rq join sd on sd.area_id = rq.area_id and sd.origin = rq.lat || '|' || rq.lon where radius_m - d0 >= 1
), rc as (select request_id, ux.area_id, id, d, radius_m from ux join sp on sp.area_id = ux.area_id and sp.origin = ux.origin where d <= radius_m
), bp as (
  select request_id, lat, lon, false as is_cut from rc join gn using (area_id, id)
  union all
  select request_id, p.lat + (q.lat - p.lat) * ((radius_m - d) / w), p.lon + (q.lon - p.lon) * ((radius_m - d) / w), true
  from rc join arcs on arcs.area_id = rc.area_id and arcs.a = rc.id join gn p on p.area_id = rc.area_id and p.id = arcs.a join gn q on q.area_id = rc.area_id and q.id = arcs.b where radius_m - d > 0 and radius_m - d < w
)"""
#: Distinct points of the plane around each request's position, in whole centimetres.
LOCAL = """, lp as materialized (select distinct request_id, cast(floor((bp.lon - rq.lon) * (111320e0 * greatest(0.2e0, cos(radians(rq.lat)))) * 100 + 0.5) as bigint) as x, cast(floor((bp.lat - rq.lat) * 111320e0 * 100 + 0.5) as bigint) as y from bp join rq using (request_id))"""
#: A point is a corner where the directions to all others leave more than half a turn open; coordinates are whole, so the test is exact.
CONVEX = """, dir as (select a.request_id, a.x, a.y, b.x - a.x as dx, b.y - a.y as dy from lp a join lp b on a.request_id = b.request_id and (a.x <> b.x or a.y <> b.y)
), trn as (select *, coalesce(lead(dx) over w, first_value(dx) over w) as nx, coalesce(lead(dy) over w, first_value(dy) over w) as ny from dir window w as (partition by request_id, x, y order by atan2(dy, dx), dx, dy)
), cn as (select distinct request_id, x, y from trn where dx * ny - dy * nx < 0)"""
#: Requests whose points don't all lie on one line.
SOLID = """, ends as (select request_id, arg_min(x, (x, y)) as x0, arg_min(y, (x, y)) as y0, arg_max(x, (x, y)) as x1, arg_max(y, (x, y)) as y1 from lp group by 1
), sol as materialized (select distinct request_id from lp join ends using (request_id) where (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) <> 0)"""

SQL = {
    "net_nodes": f"with {S.ELEMENTS} select * from nd",
    "net_ways": f"with {S.ELEMENTS} select area_id, record_id, cast(attempt_no as integer) as attempt_no, cast(elem_ord as integer) as elem_ord, id, highway from wy",
    "net_recurse_down": f"with {S.ELEMENTS} select distinct area_id, id from refs join nd using (area_id, id)",
    "graph_index": f"with {S.GRAPH} select area_id, id, row_number() over (partition by area_id order by seen) - 1 as node_idx from gn",
    "graph_edges": f"with {S.GRAPH} select area_id, u, v, round(w, 6) as w, is_road from eg",
    "graph_segment_cells": f"""with {S.GRAPH}, sc as (select area_id, greatest(0.2e0, cos(radians(arg_min(lat, seen)))) as scale from gn group by 1),
k as (select area_id, u, v, cast(floor(least(u_lat, v_lat) / (250e0 / 111320e0)) as bigint) as y0, cast(floor(greatest(u_lat, v_lat) / (250e0 / 111320e0)) as bigint) as y1,
  cast(floor(least(u_lon, v_lon) * scale / (250e0 / 111320e0)) as bigint) as x0, cast(floor(greatest(u_lon, v_lon) * scale / (250e0 / 111320e0)) as bigint) as x1 from eg join sc using (area_id))
select area_id, u, v, cell_y, unnest(range(x0, x1 + 1)) as cell_x from (select *, unnest(range(y0, y1 + 1)) as cell_y from k)""",
    "graph_crossings": f"with {S.CROSS} select area_id, u, v, round(w, 6) as w from cx",
    "graph_components": f"with recursive {S.CROSS}{S.COMPONENTS} select area_id, id, component, size, substantial from cm join cs using (area_id, component)",
    "snap_edges": f"with {S.CROSS}{S.ORIGINS}, sn as ({S.snap_sql('og', 'ex', '250e0')}) select area_id, origin, round(snap_m, 6) as snap_m from sn",
    "snap_seeds": f"with recursive {S.CROSS}{S.ORIGINS}{S.SEEDS} select area_id, origin, id, round(d0, 6) as d0 from sd",
    "walk_distances": f"with recursive {S.CROSS}{S.ORIGINS}{S.PATHS} select area_id, origin, id, round(d, 6) as d from sp",
    "walk_boundary": f"with recursive {S.CROSS}{S.ORIGINS}{S.PATHS}{BOUNDARY} select request_id, count(*) as points, count(*) filter (is_cut) as cuts, round(max(lat), 7) as lat, round(max(lon), 7) as lon from bp group by 1",
    "walk_local": f"with recursive {S.CROSS}{S.ORIGINS}{S.PATHS}{BOUNDARY}{LOCAL} select request_id, count(*) as points, min(x) as west, max(x) as east, min(y) as south, max(y) as north from lp group by 1",
    "walk_convex": f"with recursive {S.CROSS}{S.ORIGINS}{S.PATHS}{BOUNDARY}{LOCAL}{CONVEX}{SOLID} select request_id, count(*) as corners from cn semi join sol using (request_id) group by 1",
    "walk_states": f"""with recursive {S.CROSS}{S.ORIGINS}{S.PATHS}{BOUNDARY}{LOCAL}{SOLID}
select request_id, case when request_id in (select request_id from sol) then 'polygon' when request_id in (select request_id from rq join sd on sd.area_id = rq.area_id and sd.origin = rq.lat || '|' || rq.lon) then 'invalid-polygon' else 'no-nearby-edge' end as state
from (select distinct request_id from requests)""",
    "walk_radii": f"""with recursive {S.CROSS}{S.origins_sql(S.ASKED.replace(S.CLAMP, "300e0"))}{S.PATHS}
select area_id, origin, count(*) as nodes, r as radius_m from sp join (select unnest([100e0, 200e0, 300e0]) as r) on d <= r group by area_id, origin, r""",
}
