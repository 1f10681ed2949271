"""From tagged map nodes to the stop register: classification, near-duplicates, order, file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footmesh.functions.geo import finite
from footmesh.operators.stops import drop_near_duplicates
from footmesh.runtime import cut

# The name of a stop that has none, and the tags that make a node a stop.
UNNAMED = "Unbekannte Haltestelle"
LEGACY = (("railway", "tram_stop", "tram"), ("railway", "station", "train"), ("railway", "halt", "train"), ("highway", "bus_stop", "bus"), ("amenity", "bus_station", "bus"))
STATION = ("public_transport", "station")
MODE_FLAGS = (("train", "train"), ("tram", "tram"), ("light_rail", "tram"), ("bus", "bus"), ("trolleybus", "bus"))


def tag_is(tags: Column, key: str, value: str) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(key)) == value, F.lit(False))


def classify(tags: Column) -> Column:
    """The mode of a node by its tags, the first rule that holds; null where none does, or without tags."""
    out = F.lit(None).cast("string")
    station = tag_is(tags, *STATION)
    for flag, mode in reversed(MODE_FLAGS):
        out = F.when(station & tag_is(tags, flag, "yes"), mode).otherwise(out)
    for key, value, mode in reversed(LEGACY):
        out = F.when(tag_is(tags, key, value), mode).otherwise(out)
    return out


def legacy_tagged(tags: Column) -> Column:
    out = F.lit(False)
    for key, value, _ in LEGACY:
        out = out | tag_is(tags, key, value)
    return out


def is_stop_node(tags: Column) -> Column:
    """The predicate that the stop scan pushes to its source: tagged as a stop, or as a station of any mode."""
    return legacy_tagged(tags) | tag_is(tags, *STATION)


def stops_from_nodes(nodes: DataFrame, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``nodes``: id bigint, lat, lon, tags map<string,string>. The register's rows: id, name, lat, lon, type.

    Nodes outside ``bounds`` (south, west, north, east), without a finite position or without a mode are
    left out; a node without a name gets UNNAMED. One that is tagged only in the newer way is dropped
    where an older-style one of the same name lies within 150 m. Repeated nodes count once.
    """
    rows = nodes.where(is_stop_node(F.col("tags")) & F.col("id").isNotNull() & finite(F.col("lat"), F.col("lon")))
    if bounds is not None:
        south, west, north, east = bounds
        rows = rows.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    name = F.coalesce(F.try_element_at("tags", F.lit("name")), F.lit(UNNAMED))
    stops = rows.select(F.concat(F.lit("osm-"), F.col("id").cast("string")).alias("id"), name.alias("name"), "lat", "lon", classify(F.col("tags")).alias("type"), (~legacy_tagged(F.col("tags"))).alias("newer"))
    stops = stops.where("type is not null").distinct()
    return drop_near_duplicates(stops, F.col("newer")).select("id", "name", "lat", "lon", "type")


def german_order(stops: DataFrame, buckets: int = 64) -> DataFrame:
    """Add ``pos``, the place of each stop by name in German order, then id, from 0.

    Sorting is by ranges: rows are range-partitioned by name, numbered within their partition and shifted
    by the counts of the partitions before (one row a bucket), so no task sorts all rows.
    """
    order = [F.collate("name", "de"), "id", "lat", "lon", "type"]
    # ranges by name alone would put a placeholder name that a third of all stops share into one task
    ranged = stops.repartitionByRange(buckets, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # the upper bits of the running id are the partition's number, the lower ones the row's place in it
    ranged = cut(ranged.withColumns({"_p": F.shiftright("_at", 33), "_k": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at"))
    before = ranged.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn("pos", F.col("_before") + F.col("_k")).drop("_p", "_k", "_before")


def write_register(stops: DataFrame, path: str) -> None:
    """The register as JSON lines in German order of names; the folder is replaced as a whole."""
    stops.orderBy(F.collate("name", "de"), "id").write.mode("overwrite").json(path)
