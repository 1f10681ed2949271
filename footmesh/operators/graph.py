"""Walk graphs by area: edges, crossings, components, snapping, bounded shortest paths and boundaries.

All search is by equi-joins on grid cells. Routing is a search of batches of nearby origins over the edges
around them, or a relaxation join repeated until nothing improves. Graphs are keyed by area and node id; where a rule depends on the order in which nodes first
appear in the ways, that order is carried as a struct instead of a running number.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footmesh.functions.geo import METERS_PER_DEGREE, haversine_m, lon_scale
from footmesh.operators.stops import BATCH, CELL_LAT, CELL_LON, numbered
from footmesh.runtime import cut
from footmesh.sources.network import ORDER, ROADS

# Fixed values, in metres (and nodes).
SNAP_M, BRIDGE_M = 250.0, 40.0
CROSSING_MIN_M, CROSSING_MAX_M = 3.0, 30.0
MIN_COMPONENT, COMPONENT_SHARE = 30, 0.1
MIN_WALK_M = 1.0
# Degrees beside either end of an edge over the 180th meridian in which it is searched.
WRAP_DEG = 0.1
# Cells of a batch's width around the globe.
AROUND = round(360 / CELL_LON)


def way_refs(ways: DataFrame) -> DataFrame:
    return ways.select("area_id", *ORDER, "highway", F.posexplode("nodes").alias("pos", "id"))


def graph_nodes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """area_id, id, lat, lon, seen: the nodes on ways that are delivered; ``seen`` orders them by first appearance."""
    first = way_refs(ways).where("id is not null").groupBy("area_id", "id").agg(F.min(F.struct(*ORDER, "pos")).alias("seen"))
    return first.join(nodes, ["area_id", "id"])


def node_index(graph: DataFrame) -> DataFrame:
    """area_id, id, node_idx: a dense number from 0 by first appearance.

    Numbered within each record, a bounded group, and shifted by the counts of the records before, so
    that an area of any size needs no sort in one task.
    """
    rows = graph.select("area_id", "id", "seen", F.col("seen.record_id").alias("record_id"))
    counts = rows.groupBy("area_id", "record_id").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("area_id").orderBy("record_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rn = F.row_number().over(W.partitionBy("area_id", "record_id").orderBy("seen"))
    return rows.withColumn("rn", rn).join(before, ["area_id", "record_id"]).select("area_id", "id", (F.col("before") + F.col("rn") - 1).alias("node_idx"))


def way_edges(ways: DataFrame, graph: DataFrame) -> DataFrame:
    """area_id, u, v (ids, the smaller first), w, is_road: consecutive references whose nodes are both there.

    A missing node breaks the way, it is not skipped over. The first way of several that connect two
    nodes tells whether the edge is a road. Edges without length are left out.
    """
    pair = F.filter(F.transform(F.slice("nodes", 1, F.greatest(F.size("nodes") - 1, F.lit(0))), lambda x, i: F.struct(i.alias("pos"), x.alias("a"), F.get("nodes", i + 1).alias("b"))), lambda p: (p["a"] != p["b"]))
    rows = ways.where("size(nodes) > 1").select("area_id", *ORDER, "highway", F.explode(pair).alias("p"))
    rows = rows.select("area_id", F.least("p.a", "p.b").alias("u"), F.greatest("p.a", "p.b").alias("v"), F.struct(*ORDER, "p.pos").alias("at"), F.col("highway").isin(*ROADS).alias("is_road"))
    edges = rows.groupBy("area_id", "u", "v").agg(F.min_by("is_road", "at").alias("is_road"))
    a = graph.select("area_id", F.col("id").alias("u"), F.col("lat").alias("u_lat"), F.col("lon").alias("u_lon"))
    b = graph.select("area_id", F.col("id").alias("v"), F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"))
    out = edges.join(a, ["area_id", "u"]).join(b, ["area_id", "v"])
    w = haversine_m(F.col("u_lat"), F.col("u_lon"), F.col("v_lat"), F.col("v_lon"))
    return out.select("area_id", "u", "v", w.alias("w"), "is_road", "u_lat", "u_lon", "v_lat", "v_lon").where("w > 0")


def area_scale(graph: DataFrame) -> DataFrame:
    """area_id, scale: the longitude scale of the area's grid, that of its first node."""
    return graph.groupBy("area_id").agg(lon_scale(F.min_by("lat", "seen")).alias("scale"))


def cells(size_m: float, lat0: Column, lat1: Column, lon0: Column, lon1: Column, pad_m: float = 0.0) -> Column:
    """Cells (y, x) of a grid that a box touches; the column ``scale`` narrows longitudes.

    A box that spans more than half the globe belongs to an edge over the 180th meridian: it touches the
    cells within WRAP_DEG of its two ends, not the many around the globe between them.
    """
    size, pad = size_m / METERS_PER_DEGREE, pad_m / METERS_PER_DEGREE
    at = lambda c: F.floor(c / size).cast("bigint")
    scale = F.col("scale")
    ys = F.sequence(at(F.least(lat0, lat1) - pad), at(F.greatest(lat0, lat1) + pad))
    low, high = F.least(lon0, lon1) * scale, F.greatest(lon0, lon1) * scale
    ends = F.concat(F.sequence(at(low - pad), at(low + WRAP_DEG)), F.sequence(at(high - WRAP_DEG), at(high + pad)))
    xs = F.when(high - low > 180 * scale, ends).otherwise(F.sequence(at(low - pad), at(F.when(high - low > 180 * scale, low).otherwise(high) + pad)))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(y.alias("y"), x.alias("x")))))


def segment_cells(edges: DataFrame, scale: DataFrame, size_m: float = SNAP_M) -> DataFrame:
    """The edges by cell in which they are searched; those over the 180th meridian have only the cells near their ends."""
    c = cells(size_m, F.col("u_lat"), F.col("v_lat"), F.col("u_lon"), F.col("v_lon"))
    return edges.join(scale, "area_id").withColumn("cell", F.explode(c))


def whole_segment_cells(edges: DataFrame, scale: DataFrame, size_m: float = SNAP_M) -> DataFrame:
    """area_id, u, v, cell_y, cell_x: every cell of an edge's box in raw degrees, around the globe for one over the 180th meridian."""
    at = lambda c: F.floor(c / (size_m / METERS_PER_DEGREE)).cast("bigint")
    low, high = F.least("u_lon", "v_lon") * F.col("scale"), F.greatest("u_lon", "v_lon") * F.col("scale")
    rows = edges.join(scale, "area_id").withColumn("cell_y", F.explode(F.sequence(at(F.least("u_lat", "v_lat")), at(F.greatest("u_lat", "v_lat")))))
    return rows.withColumn("cell_x", F.explode(F.sequence(at(low), at(high)))).select("area_id", "u", "v", "cell_y", "cell_x")


def crossings(graph: DataFrame, edges: DataFrame) -> DataFrame:
    """area_id, u, v, w: each node's best street crossing.

    From a node that is on no road to a later such node 3 to 30 m away, straight across a road and
    roughly at right angles to it; the nearest one, or of equals that of the first cell and then node.
    Where the best is an edge already, the node gets none.
    """
    scale = area_scale(graph)
    roads = edges.where("is_road")
    on_road = roads.select("area_id", F.explode(F.array("u", "v")).alias("id")).distinct()
    size = CROSSING_MAX_M / METERS_PER_DEGREE
    off = graph.join(on_road, ["area_id", "id"], "left_anti").join(scale, "area_id")
    off = off.withColumns({"cy": F.floor(F.col("lat") / size).cast("bigint"), "cx": F.floor(F.col("lon") * F.col("scale") / size).cast("bigint")})
    here = off.select("area_id", "scale", F.col("id").alias("a"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.col("seen").alias("a_seen"), "cy", "cx")
    here = here.withColumn("dy", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn("dx", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    here = here.withColumns({"cy": F.col("cy") + F.col("dy"), "cx": F.col("cx") + F.col("dx")})
    there = off.select("area_id", F.col("id").alias("b"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), F.col("seen").alias("b_seen"), "cy", "cx")
    pairs = here.join(there, ["area_id", "cy", "cx"]).where("b_seen > a_seen")
    pairs = pairs.withColumn("w", haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))).where(F.col("w").between(CROSSING_MIN_M, CROSSING_MAX_M))
    line = pairs.withColumn("cell", F.explode(cells(CROSSING_MAX_M, F.col("a_lat"), F.col("b_lat"), F.col("a_lon"), F.col("b_lon")))).drop("scale")
    road = segment_cells(roads, scale, CROSSING_MAX_M).select("area_id", "cell", "u_lat", "u_lon", "v_lat", "v_lon")
    turn = lambda p, q, r: (F.col(f"{q}_lon") - F.col(f"{p}_lon")) * (F.col(f"{r}_lat") - F.col(f"{p}_lat")) - (F.col(f"{q}_lat") - F.col(f"{p}_lat")) * (F.col(f"{r}_lon") - F.col(f"{p}_lon"))
    meets = (turn("a", "b", "u") * turn("a", "b", "v") < 0) & (turn("u", "v", "a") * turn("u", "v", "b") < 0)
    k = lon_scale((F.col("a_lat") + F.col("b_lat")) / 2)
    x0, y0, x1, y1 = (F.col("b_lon") - F.col("a_lon")) * k, F.col("b_lat") - F.col("a_lat"), (F.col("v_lon") - F.col("u_lon")) * k, F.col("v_lat") - F.col("u_lat")
    norm = F.hypot(x0, y0) * F.hypot(x1, y1)
    square = F.when(norm > 0, F.abs((x0 * x1 + y0 * y1) / norm) <= 0.5).otherwise(False)
    # a pair and a road may share several cells; the aggregation below takes the pair once
    good = line.join(road, ["area_id", "cell"]).where(meets & square)
    best = good.groupBy("area_id", "a").agg(F.min(F.struct("w", "dy", "dx", "b_seen", "b")).alias("m"))
    out = best.select("area_id", F.least("a", "m.b").alias("u"), F.greatest("a", "m.b").alias("v"), F.col("m.w").alias("w")).distinct()
    return out.join(edges.select("area_id", "u", "v"), ["area_id", "u", "v"], "left_anti")


def with_crossings(graph: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with the inferred crossings added."""
    at = lambda p: graph.select("area_id", F.col("id").alias(p), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    extra = crossings(graph, edges).withColumn("is_road", F.lit(False)).join(at("u"), ["area_id", "u"]).join(at("v"), ["area_id", "v"])
    return edges.unionByName(extra.select(*edges.columns))


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace the edges of each batch by a star around the smallest node of each of its components."""
    for frame in frames:
        up: dict = {}

        def root(k, up=up):
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for a, u, v in zip(frame["area_id"], frame["u"].tolist(), frame["v"].tolist()):
            for k in ((a, u), (a, v)):
                up.setdefault(k, k)
            p, q = root((a, u)), root((a, v))
            if p != q:
                up[max(p, q)] = min(p, q)
        stars = [(k[0], root(k)[1], k[1]) for k in up if root(k) != k]
        yield pd.DataFrame({"area_id": pd.Series([s[0] for s in stars], dtype=object), "u": np.array([s[1] for s in stars], np.int64), "v": np.array([s[2] for s in stars], np.int64)})


def components(graph: DataFrame, edges: DataFrame) -> DataFrame:
    """area_id, id, component: connected components, each named by its smallest node id.

    Alternating large-star and small-star steps (Kiveris et al. 2014), which end after a number of
    rounds that grows with the logarithm of the size, whatever the diameter. Before that, neighbouring
    edges are brought together and each batch of them is contracted, which settles most components.
    """
    near = edges.select("area_id", "u", "v", F.floor(F.col("u_lat") / 0.02).alias("y"), F.floor(F.col("u_lon") / 0.03).alias("x")).repartition("area_id", "y", "x")
    pairs = cut(near.select("area_id", "u", "v").mapInPandas(_contract, "area_id string, u bigint, v bigint").distinct())
    # a set of pairs is told by its size and the sum of its rows' hashes, so a round is compared without a join
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("area_id", "u", "v").cast("decimal(38,0)"))).first()
    state = mark(pairs)
    while True:
        both = pairs.unionByName(pairs.select("area_id", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("area_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, ["area_id", "u"]).where("v > u").select("area_id", F.col("m").alias("u"), "v").where("u <> v").distinct()
        down = large.select("area_id", F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y"))
        lows = down.groupBy("area_id", "x").agg(F.min("y").alias("m"))
        small = down.join(lows, ["area_id", "x"]).select("area_id", F.col("m").alias("u"), F.explode(F.array("x", "y")).alias("v")).where("u <> v").distinct()
        after = cut(small)
        before, state, pairs = state, mark(after), after
        if state == before:
            break
    roots = pairs.groupBy("area_id", F.col("v").alias("id")).agg(F.min("u").alias("component"))
    return graph.select("area_id", "id").join(roots, ["area_id", "id"], "left").select("area_id", "id", F.coalesce("component", "id").alias("component"))


def component_sizes(comp: DataFrame) -> DataFrame:
    """area_id, component, size, substantial: at least 30 nodes and a tenth of the area's largest."""
    sizes = comp.groupBy("area_id", "component").agg(F.count("*").alias("size"))
    most = sizes.groupBy("area_id").agg(F.max("size").alias("largest"))
    enough = F.col("size") >= F.greatest(F.lit(MIN_COMPONENT), F.floor(F.col("largest") * COMPONENT_SHARE))
    return sizes.join(most, "area_id").select("area_id", "component", "size", enough.alias("substantial"))


def nearest_edges(origins: DataFrame, edges: DataFrame, scale: DataFrame, max_m: float) -> DataFrame:
    """``origins``: area_id, origin, lat, lon. Each origin's nearest edge within ``max_m``: snap_m, to_u_m, to_v_m.

    Equal distances are settled by the edges' geometry, never by the order of arrival.
    """
    near = origins.join(scale, "area_id").withColumn("cell", F.explode(cells(SNAP_M, F.col("lat"), F.col("lat"), F.col("lon"), F.col("lon"), max_m))).drop("scale")
    rows = near.join(segment_cells(edges, scale).drop("scale", "is_road"), ["area_id", "cell"]).drop("cell")
    k = lon_scale(F.col("lat"))
    ax, ay = (F.col("u_lon") - F.col("lon")) * k, F.col("u_lat") - F.col("lat")
    dx, dy = (F.col("v_lon") - F.col("lon")) * k - ax, (F.col("v_lat") - F.col("lat")) - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / square)))
    rows = rows.withColumn("t", t)
    rows = rows.withColumn("snap_m", haversine_m(F.col("lat"), F.col("lon"), F.col("u_lat") + (F.col("v_lat") - F.col("u_lat")) * F.col("t"), F.col("u_lon") + (F.col("v_lon") - F.col("u_lon")) * F.col("t")))
    p, q = F.struct(F.col("u_lat").alias("y"), F.col("u_lon").alias("x")), F.struct(F.col("v_lat").alias("y"), F.col("v_lon").alias("x"))
    order = F.struct("snap_m", F.least(p, q).alias("p"), F.greatest(p, q).alias("q"), "u", "v")
    best = rows.where(F.col("snap_m") <= max_m).groupBy("area_id", "origin").agg(F.min_by(F.struct("u", "v", "snap_m", (F.col("w") * F.col("t")).alias("to_u_m"), (F.col("w") * (1 - F.col("t"))).alias("to_v_m")), order).alias("m"))
    return best.select("area_id", "origin", "m.*")


def seeds(origins: DataFrame, graph: DataFrame, edges: DataFrame, comp: DataFrame) -> DataFrame:
    """area_id, origin, id, d0: both ends of the nearest edge and, where that is on a small stub, of the nearest edge of a substantial component within 40 m."""
    scale = cut(area_scale(graph))
    near = cut(nearest_edges(origins, edges, scale, SNAP_M))
    sizes = cut(component_sizes(comp))
    big = comp.join(sizes.where("substantial"), ["area_id", "component"], "left_semi").select("area_id", F.col("id").alias("u"))
    stubs = near.join(big, ["area_id", "u"], "left_anti").select("area_id", "origin")
    bridges = nearest_edges(origins.join(stubs, ["area_id", "origin"]), edges.join(big, ["area_id", "u"], "left_semi"), scale, BRIDGE_M)
    ends = F.explode(F.array(F.struct(F.col("u").alias("id"), (F.col("snap_m") + F.col("to_u_m")).alias("d0")), F.struct(F.col("v").alias("id"), (F.col("snap_m") + F.col("to_v_m")).alias("d0"))))
    return near.unionByName(bridges).select("area_id", "origin", ends.alias("s")).groupBy("area_id", "origin", "s.id").agg(F.min("s.d0").alias("d0"))


def shortest_paths(start: DataFrame, edges: DataFrame, budget: DataFrame) -> DataFrame:
    """area_id, origin, id, d: walking distances within each origin's budget, inclusive.

    ``start``: area_id, origin, id, d0; ``budget``: area_id, origin, max_m. The frontier is joined with
    the edges until no distance improves; a round carries one row a reached node and origin.
    """
    both = edges.select("area_id", F.col("u").alias("id"), F.col("v").alias("to"), "w").unionByName(edges.select("area_id", F.col("v").alias("id"), F.col("u").alias("to"), "w"))
    both = cut(both)
    ok = start.join(budget, ["area_id", "origin"]).where("d0 >= 0 and d0 <= max_m and not isnan(d0)")
    known = cut(ok.groupBy("area_id", "origin", "id").agg(F.min("d0").alias("d"), F.max("max_m").alias("max_m"), F.lit(True).alias("fresh")))
    while not known.where("fresh").isEmpty():
        step = known.where("fresh").join(both, ["area_id", "id"]).select("area_id", "origin", F.col("to").alias("id"), (F.col("d") + F.col("w")).alias("d"), "max_m", F.lit(True).alias("fresh")).where("d <= max_m")
        every = known.withColumn("fresh", F.lit(False)).unionByName(step)
        # the old row wins a tie, so a node is fresh only when its distance fell
        merged = every.groupBy("area_id", "origin", "id").agg(F.min(F.struct("d", "fresh")).alias("m"), F.max("max_m").alias("max_m"))
        known = cut(merged.select("area_id", "origin", "id", "m.d", "max_m", "m.fresh"))
    return known.select("area_id", "origin", "id", "d")


def _batch_search(key: tuple, seeds_in: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
    """Shortest paths of a batch's origins over the edges around them."""
    out: dict[str, list] = {"area_id": [], "origin": [], "id": [], "d": []}
    names = np.unique(np.concatenate([arcs["u"].to_numpy(np.int64), arcs["v"].to_numpy(np.int64), seeds_in["id"].to_numpy(np.int64)]))
    u, v = np.searchsorted(names, arcs["u"].to_numpy(np.int64)), np.searchsorted(names, arcs["v"].to_numpy(np.int64))
    tails, heads, w = np.r_[u, v], np.r_[v, u], np.tile(arcs["w"].to_numpy(float), 2)
    order = np.argsort(tails, kind="stable")
    begin = np.searchsorted(tails[order], np.arange(len(names) + 1)).tolist()
    heads, w, labels = heads[order].tolist(), w[order].tolist(), names.tolist()
    for origin, part in seeds_in.groupby("origin", sort=False):
        most = float(part["max_m"].iloc[0])
        best = {}
        todo = [(float(d), int(k)) for d, k in zip(part["d0"], np.searchsorted(names, part["id"].to_numpy(np.int64)))]
        heapq.heapify(todo)
        while todo:
            d, k = heapq.heappop(todo)
            if k in best:
                continue
            best[k] = d
            for e in range(begin[k], begin[k + 1]):
                if heads[e] not in best and d + w[e] <= most:
                    heapq.heappush(todo, (d + w[e], heads[e]))
        out["area_id"] += [key[0]] * len(best)
        out["origin"] += [origin] * len(best)
        out["id"] += [labels[k] for k in best]
        out["d"] += best.values()
    return pd.DataFrame({c: pd.Series(x, dtype={"id": np.int64, "d": float}.get(c, object)) for c, x in out.items()})


def batched_paths(start: DataFrame, edges: DataFrame, budget: DataFrame, origins: DataFrame) -> DataFrame:
    """The same distances as ``shortest_paths`` without rounds: origins of a small cell are searched together.

    ``origins``: area_id, origin, lat, lon. A batch holds at most 48 origins of a cell and the edges within
    the largest budget of it, which geography bounds; an origin's paths cannot lead farther than its
    budget. Cells are counted around the globe, so paths may pass the 180th meridian.
    """
    rows = origins.join(budget, ["area_id", "origin"]).withColumns({"cy": F.floor(F.col("lat") / CELL_LAT).cast("bigint"), "cx": F.pmod(F.floor(F.col("lon") / CELL_LON), F.lit(AROUND)).cast("bigint")})
    rows = numbered(rows, ["area_id", "cy", "cx"], F.expr("right(origin, 2)"), ["origin"], "_no").withColumn("batch", F.floor(F.col("_no") / BATCH).cast("bigint"))
    rows = cut(rows.select("area_id", "origin", "max_m", "cy", "cx", "batch"))
    ok = start.join(rows, ["area_id", "origin"]).where("d0 >= 0 and d0 <= max_m and not isnan(d0)")
    # a batch needs the edges of the cells within its own largest budget, so batches look for edges and no edge is copied to every batch of the area
    batches = rows.groupBy("area_id", "cy", "cx", "batch").agg(F.max("max_m").alias("most"))
    pad = F.col("most") / 110_000.0
    low, high = F.col("cy") * CELL_LAT - pad, (F.col("cy") + 1) * CELL_LAT + pad
    across = F.least(F.lit(180.0), pad / F.greatest(F.lit(1e-4), F.cos(F.radians(F.least(F.lit(89.99), F.greatest(F.abs(low), F.abs(high)) + pad)))))
    at = lambda c, size: F.floor(c / size).cast("bigint")
    batches = batches.withColumn("ey", F.explode(F.sequence(at(low, CELL_LAT), at(high, CELL_LAT))))
    xs = F.sequence(at(F.col("cx") * CELL_LON - across, CELL_LON), at((F.col("cx") + 1) * CELL_LON + across, CELL_LON))
    batches = batches.withColumn("ex", F.explode(F.array_distinct(F.transform(xs, lambda x: F.pmod(x, F.lit(AROUND)).cast("bigint")))))
    # an edge lies in the cell of its first end; it is within reach if either end is
    ends = F.explode(F.array(F.struct(F.col("u_lat").alias("y"), F.col("u_lon").alias("x")), F.struct(F.col("v_lat").alias("y"), F.col("v_lon").alias("x")))).alias("p")
    held = edges.select("area_id", "u", "v", "w", ends).select("area_id", "u", "v", "w", at(F.col("p.y"), CELL_LAT).alias("ey"), F.pmod(at(F.col("p.x"), CELL_LON), F.lit(AROUND)).cast("bigint").alias("ex")).distinct()
    near = batches.join(held, ["area_id", "ey", "ex"]).select("area_id", "cy", "cx", "batch", "u", "v", "w").distinct()
    keys = ["area_id", "cy", "cx", "batch"]
    # the two sides share columns of the batches, so one side's are renamed
    near = near.select(*(F.col(k).alias(f"n_{k}") for k in keys), "u", "v", "w")
    return ok.select(*keys, "origin", "id", "d0", "max_m").groupBy(*keys).cogroup(near.groupBy(*(f"n_{k}" for k in keys))).applyInPandas(lambda k, a, b: _batch_search(k, a, b), "area_id string, origin string, id bigint, d double")


def boundary_points(paths: DataFrame, graph: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked``: area_id, origin, request_id, radius_m. The reachable nodes, and the points on edges where the budget ends: request_id, lat, lon, is_cut."""
    reach = paths.join(asked, ["area_id", "origin"]).where("d <= radius_m")
    at = graph.select("area_id", "id", "lat", "lon")
    nodes = reach.join(at, ["area_id", "id"]).select("request_id", "lat", "lon", F.lit(False).alias("is_cut"))
    out = edges.select("area_id", F.col("u").alias("id"), "w", *(F.col(f"u_{c}").alias(f"a_{c}") for c in ("lat", "lon")), *(F.col(f"v_{c}").alias(f"b_{c}") for c in ("lat", "lon")))
    back = edges.select("area_id", F.col("v").alias("id"), "w", *(F.col(f"v_{c}").alias(f"a_{c}") for c in ("lat", "lon")), *(F.col(f"u_{c}").alias(f"b_{c}") for c in ("lat", "lon")))
    left = F.col("radius_m") - F.col("d")
    cuts = reach.join(out.unionByName(back), ["area_id", "id"]).where((left > 0) & (left < F.col("w"))).withColumn("t", left / F.col("w"))
    along = lambda c: (F.col(f"a_{c}") + (F.col(f"b_{c}") - F.col(f"a_{c}")) * F.col("t")).alias(c)
    return nodes.unionByName(cuts.select("request_id", along("lat"), along("lon"), F.lit(True).alias("is_cut")))


def local_points(points: DataFrame, centres: DataFrame) -> DataFrame:
    """``centres``: request_id, c_lat, c_lon. Distinct points on a centimetre grid of the plane around each centre: request_id, x, y."""
    k = F.lit(METERS_PER_DEGREE) * lon_scale(F.col("c_lat"))
    snap = lambda c: F.floor(c * 100 + 0.5).cast("double") / 100
    rows = points.join(centres, "request_id")
    return rows.select("request_id", "c_lat", "c_lon", snap((F.col("lon") - F.col("c_lon")) * k).alias("x"), snap((F.col("lat") - F.col("c_lat")) * METERS_PER_DEGREE).alias("y")).distinct()
