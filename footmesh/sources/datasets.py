"""Shipped polygon datasets: one Parquet partition a stop type and radius. Stored results: versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_datasets(polygons: DataFrame, path: str) -> None:
    """``polygons``: type, radius_m, polygon_key, encoded. Replaces only the partitions at hand; empty polygons are not written."""
    rows = polygons.where(F.size("encoded") >= 6).repartition("type", "radius_m").sortWithinPartitions("type", "radius_m", "polygon_key")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("type", "radius_m").parquet(path)


def read_datasets(spark: SparkSession, path: str, type_: str | None = None, radius_m: int | None = None) -> DataFrame:
    """All polygons, or those of one partition; a partition that is not there has no rows."""
    rows = spark.read.parquet(path)
    if type_ is not None:
        rows = rows.where(F.col("type") == type_)
    return rows if radius_m is None else rows.where(F.col("radius_m") == radius_m)


def upserted(stored: DataFrame, changes: DataFrame, key: str, at: str) -> DataFrame:
    """``stored`` with ``changes`` put over it by key, the latest by ``at`` of several; a change whose ``kind`` is null deletes.

    Both have the same columns. A null key changes nothing. The result is a new table: write it beside the
    old one and switch, since a table cannot be overwritten while it is read.
    """
    columns = stored.columns
    last = changes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*columns), F.struct(at, *[c for c in columns if c not in (at, key)])).alias("_v"))
    kept = stored.join(last.select(F.col("_k").alias(key)), key, "left_anti").select(*columns)
    return kept.unionByName(last.where("_v.kind is not null").select("_v.*"))
