"""Street networks from raw fetch records, as flat tables keyed by area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmesh.functions.geo import finite
from footmesh.operators.nested import Level, as_list, as_map, child_level, number_text, once, one_each
from footmesh.runtime import cut

# Ways that are not for walking, as a pattern found anywhere in the tag's value, and the kinds of ways that count as roads to cross.
NOT_WALKABLE = "motorway|motorway_link|trunk|trunk_link|construction|proposed|bus_guideway|raceway|bridleway|corridor|escape"
ROADS = ("primary", "secondary", "tertiary", "residential", "unclassified", "service", "living_street")

ORDER = ("record_id", "attempt_no", "elem_ord")


def elements(responses: DataFrame, key: str = "record_id", body: str = "body", order: str | None = "received_at") -> DataFrame:
    """area_id, record_id, attempt_no, elem_ord, kind, id, value of all node and way elements that have an id."""
    records = one_each(responses, key, body, order)
    rows = records.select(F.col("row_key").cast("bigint").alias("record_id"), F.try_variant_get("value", "$.batch.area_id", "string").alias("area_id"), "value")
    rows = child_level(rows, Level("$.attempts[]", "$", "attempts", "list"), keep=("record_id", "area_id")).withColumnRenamed("ord", "attempt_no")
    rows = child_level(rows, Level("$.attempts[].response.elements[]", "$.attempts[]", "response.elements", "list"), keep=("record_id", "area_id", "attempt_no")).withColumnRenamed("ord", "elem_ord")
    kind, number = F.try_variant_get("value", "$.type", "string"), number_text(F.try_variant_get("value", "$.id", "variant")).try_cast("bigint")
    return rows.select("area_id", *ORDER, kind.alias("kind"), number.alias("id"), "value").where("kind in ('node', 'way') and id is not null and area_id is not null")


def nodes_of(elems: DataFrame) -> DataFrame:
    """area_id, id, lat, lon: the last of several nodes of one id holds; nodes without a finite position are left out."""
    lat, lon = (F.try_variant_get("value", f"$.{c}", "double") for c in ("lat", "lon"))
    rows = elems.where("kind = 'node'").select("area_id", *ORDER, "id", lat.alias("lat"), lon.alias("lon")).where(finite(F.col("lat"), F.col("lon")))
    last = rows.groupBy("area_id", "id").agg(F.max_by(F.struct("lat", "lon"), F.struct(*ORDER)).alias("p"))
    return last.select("area_id", "id", "p.lat", "p.lon")


def tag(tags: Column, name: str) -> Column:
    return F.try_variant_get(F.get(F.filter(tags, lambda e: e["key"] == name), F.lit(0))["value"], "$", "string")


def ways_of(elems: DataFrame) -> DataFrame:
    """area_id, order columns, id, nodes (array<bigint>, null entries kept), the tags that routing reads, and all tags as a map."""
    names = ("highway", "area", "indoor", "access", "foot")
    tags = once(as_map(F.try_variant_get("value", "$.tags", "variant")), lambda m: F.struct(*(tag(m, n).alias(n) for n in names)))
    refs = F.transform(as_list(F.try_variant_get("value", "$.nodes", "variant")), lambda x: number_text(x).try_cast("bigint"))
    rows = elems.where("kind = 'way'").select("area_id", *ORDER, "id", F.coalesce(refs, F.array().cast("array<bigint>")).alias("nodes"), F.explode(F.array(tags)).alias("t"))
    return rows.select("area_id", *ORDER, "id", "nodes", *(F.col(f"t.{n}").alias(n) for n in names))


def walkable(ways: DataFrame) -> DataFrame:
    """Ways to walk on. The patterns are found anywhere in a value: an access of "unknown" holds "no"."""
    lacks = lambda c, pattern: F.coalesce(~F.col(c).rlike(pattern), F.lit(True))
    differs = lambda c, value: F.coalesce(F.col(c) != value, F.lit(True))
    return ways.where(F.col("highway").isNotNull() & lacks("highway", NOT_WALKABLE) & differs("area", "yes") & differs("indoor", "yes") & lacks("access", "private|no") & lacks("foot", "no"))


def recurse_down(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes that the ways refer to, wherever they lie."""
    refs = ways.select("area_id", F.explode("nodes").alias("id")).where("id is not null").distinct()
    return nodes.join(refs, ["area_id", "id"], "left_semi")


def load_network(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, walkable ways) of all areas."""
    elems = cut(elements(responses))
    return cut(nodes_of(elems)), cut(walkable(ways_of(elems)))
