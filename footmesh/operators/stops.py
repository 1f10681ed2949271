"""Stop tables: guards, union, near-duplicate removal, batches and query areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footmesh.functions.codec import to_fixed
from footmesh.functions.geo import METERS_PER_DEGREE, finite
from footmesh.functions.scalars import PADDING_M, box_area_m2, outward, pad_box, radius_bucket

# Modes in canonical order with their default radius in metres; a batch's cell in degrees and its size.
TYPES = {"tram": 300.0, "train": 400.0, "bus": 200.0}
CELL_LAT, CELL_LON, BATCH = 0.01, 0.015, 48
DUPLICATE_M = 150.0


def default_radius(type_: Column) -> Column:
    out = F.when(type_ == "tram", TYPES["tram"])
    for t in ("train", "bus"):
        out = out.when(type_ == t, TYPES[t])
    return out


def valid_stop(known_type: bool = True) -> Column:
    """Position finite, id and name not null, type one of the three. Latitude and longitude have no bounds."""
    ok = F.col("id").isNotNull() & F.col("name").isNotNull() & finite(F.col("lat"), F.col("lon"))
    return ok & F.col("type").isin(*TYPES) if known_type else ok


def stop_snapshot(stops: DataFrame) -> DataFrame:
    """The register's stops: bad rows and custom ones dropped, repeats once."""
    return stops.where(valid_stop() & ~F.coalesce("is_custom", F.lit(False))).select("id", "name", "lat", "lon", "type", "is_custom").distinct()


def custom_stops(custom: DataFrame) -> DataFrame:
    """Stops added by users; one without a known type becomes a tram stop."""
    rows = custom.where(valid_stop(False)).withColumn("type", F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise("tram"))
    return rows.select("id", "name", "lat", "lon", "type", F.lit(True).alias("is_custom")).distinct()


def drop_near_duplicates(stops: DataFrame, secondary: Column) -> DataFrame:
    """Without the ``secondary`` rows that have another row of the same name within 150 m (plane at the mean latitude).

    Names are joined together with grid cells, so a name that a third of all stops share is spread over
    the places where it occurs. A cell row's width in longitude follows its latitude.
    """
    size = DUPLICATE_M / METERS_PER_DEGREE
    row = lambda lat: F.floor(lat / size).cast("bigint")
    width = lambda r: size / F.greatest(F.lit(1e-3), F.cos(F.radians(F.least(F.lit(89.9), (F.abs(r) + 2) * size))))
    keyed = stops.withColumn("_second", secondary)
    first = keyed.where("not _second").withColumn("_r", row(F.col("lat"))).withColumn("_c", F.floor(F.col("lon") / width(F.col("_r"))).cast("bigint"))
    first = first.select("name", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "_r", "_c")
    second = keyed.where("_second").withColumn("_k", F.struct("id", "lat", "lon", "type"))
    around = second.select("_k", "name", "lat", "lon", F.explode(F.sequence(row(F.col("lat")) - 1, row(F.col("lat")) + 1)).alias("_r"))
    around = around.withColumn("_c", F.floor(F.col("lon") / width(F.col("_r"))).cast("bigint")).withColumn("_c", F.explode(F.sequence(F.col("_c") - 1, F.col("_c") + 1)))
    hit = around.join(first, ["name", "_r", "_c"]).where(F.hypot((F.col("lat") - F.col("_lat")) * METERS_PER_DEGREE, (F.col("lon") - F.col("_lon")) * METERS_PER_DEGREE * F.cos(F.radians((F.col("lat") + F.col("_lat")) / 2))) <= DUPLICATE_M)
    gone = hit.select("_k").distinct()
    return keyed.where("not _second").drop("_second").unionByName(second.join(gone, "_k", "left_anti").drop("_k", "_second"))


def numbered(rows: DataFrame, group: list[str], bucket: Column, order: list[str], out: str) -> DataFrame:
    """A dense number from 0 within each group, by (bucket, order): buckets are numbered apart and shifted, so no task sorts a whole group."""
    rows = rows.withColumn("_b", bucket)
    counts = rows.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rn = F.row_number().over(W.partitionBy(*group, "_b").orderBy(*order))
    return rows.withColumn("_rn", rn).join(before, [*group, "_b"]).withColumn(out, F.col("_before") + F.col("_rn") - 1).drop("_b", "_rn", "_before")


def stop_batches(stops: DataFrame) -> DataFrame:
    """id, cell_lat, cell_lon, batch_no: stops of a geographic cell in batches of at most 48."""
    rows = stops.withColumns({"cell_lat": F.floor(F.col("lat") / CELL_LAT).cast("bigint"), "cell_lon": F.floor(F.col("lon") / CELL_LON).cast("bigint")})
    rows = numbered(rows, ["cell_lat", "cell_lon"], F.expr("right(id, 2)"), ["id", "lat", "lon", "type"], "_no")
    return rows.withColumn("batch_no", F.floor(F.col("_no") / BATCH).cast("bigint")).drop("_no")


def query_areas(rows: DataFrame, group: list[str], radius: Column) -> DataFrame:
    """The padded box that serves all of a group's stops at their radii, with its cache key and rough size."""
    box = rows.groupBy(*group).agg(F.min("lat").alias("s"), F.min("lon").alias("w"), F.max("lat").alias("n"), F.max("lon").alias("e"), radius_bucket(F.max(radius)).alias("bucket_m"))
    box = box.select(*group, "bucket_m", outward(F.col("s"), False).alias("s"), outward(F.col("w"), False).alias("w"), outward(F.col("n"), True).alias("n"), outward(F.col("e"), True).alias("e"))
    key = F.concat_ws(":", *(to_fixed(F.col(c), 3) for c in "swne"), F.col("bucket_m").cast("bigint").cast("string"))
    out = box.select(*group, "bucket_m", key.alias("area_key"), *pad_box(F.col("s"), F.col("w"), F.col("n"), F.col("e"), F.col("bucket_m") + PADDING_M))
    return out.withColumn("area_m2", box_area_m2(F.col("south"), F.col("west"), F.col("north"), F.col("east")))


def in_view(lat: Column, lon: Column, south: float, west: float, north: float, east: float, share: float = 0.08) -> Column:
    """Within the view, padded by a share of its size on each side."""
    a, b = (north - south) * share, (east - west) * share
    return lat.between(south - a, north + a) & lon.between(west - b, east + b)


def centre_score(lat: Column, lon: Column, c_lat: float, c_lon: float) -> Column:
    dx = (lon - c_lon) * F.cos(F.radians(F.lit(c_lat)))
    return (lat - c_lat) * (lat - c_lat) + dx * dx
