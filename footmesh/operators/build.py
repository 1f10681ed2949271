"""The offline build: what to build, in which traversals, what came of it, and its report."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmesh.functions.scalars import half_up
from footmesh.operators.graph import MIN_WALK_M
from footmesh.operators.serving import SHIPPED_RADII
from footmesh.operators.stops import TYPES

# Batches at once where none is said, passes over what failed, and seconds of rest by number of passes done.
CONCURRENCY, RETRY_PASSES, REST_S = 2, 2, 3


@dataclass(frozen=True)
class BuildOptions:
    """What a build is asked for; ``radii`` are by type, ``limit`` None for all stops."""

    out_dir: str
    concurrency: int = CONCURRENCY
    limit: int | None = None
    types: tuple[str, ...] = tuple(TYPES)
    radii: dict[str, tuple[int, ...]] = field(default_factory=lambda: dict(SHIPPED_RADII))
    progress_file: str | None = None
    diagnostics_file: str | None = None


def _whole(value: str, option: str, least: int) -> int:
    text = value.strip()
    number = float(text) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text) else 0.0 if not text else math.nan
    if not number.is_integer() or number < least or number > 2**53 - 1:
        raise ValueError(f"{option} must be a whole number of at least {least}, not {value!r}")
    return int(number)


def parse_options(args: Sequence[str], out_dir: str) -> BuildOptions:
    """Options as ``--name value`` pairs; anything else raises ValueError. One radius needs exactly one type."""
    said: dict = {"out_dir": out_dir}
    radius = None
    names = {"--out-dir": "out_dir", "--progress-file": "progress_file", "--diagnostics-file": "diagnostics_file"}
    for at in range(0, len(args), 2):
        option, value = args[at], args[at + 1] if at + 1 < len(args) else None
        if not option.startswith("--") or value is None or value.startswith("--"):
            raise ValueError(f"an option and its value are expected, not {option!r}")
        if option == "--types":
            asked = [t.strip() for t in value.split(",")]
            if unknown := [t for t in asked if t not in TYPES]:
                raise ValueError(f"unknown stop types: {unknown}")
            said["types"] = tuple(t for t in TYPES if t in asked)
        elif option == "--concurrency":
            said["concurrency"] = _whole(value, option, 1)
        elif option == "--limit":
            said["limit"] = _whole(value, option, 0)
        elif option == "--radius":
            radius = _whole(value, option, 1)
        elif option in names:
            said[names[option]] = value
        else:
            raise ValueError(f"unknown option {option}")
    if radius is not None:
        types = said.get("types", tuple(TYPES))
        if len(types) != 1:
            raise ValueError("--radius needs exactly one type")
        if radius not in SHIPPED_RADII[types[0]]:
            raise ValueError(f"radius {radius} is not built for {types[0]}")
        said["radii"] = {**SHIPPED_RADII, types[0]: (radius,)}
    return BuildOptions(**said)


def radii_table(spark, radii: dict[str, Sequence[float]]) -> DataFrame:
    """type, radius_m: distinct radii of each type, ascending."""
    return spark.createDataFrame([(t, float(r)) for t, rs in radii.items() for r in sorted(set(rs))], "type string, radius_m double")


def select_stops(stops: DataFrame, types: Sequence[str], limit: int | None = None, order: Sequence[str] = ("id", "lat", "lon", "type")) -> DataFrame:
    """Stops to build: not a user's, of the asked types, the first ``limit`` of them in ``order`` where one is set (a top-k)."""
    rows = stops.where(~F.coalesce("is_custom", F.lit(False)) & F.col("type").isin(*types))
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def traversals(seeds: DataFrame, asked: DataFrame) -> DataFrame:
    """Radii of an origin that share one search: area_id, origin, seed_key, max_m, radii, n_seeds.

    ``seeds``: area_id, origin, id, d0; ``asked``: area_id, origin, radius_m. A seed counts for a radius that
    leaves at least a metre to walk; radii whose seeds are the same are searched once, to the largest.
    Radii without any seed are in no traversal.
    """
    rows = asked.select("area_id", "origin", "radius_m").distinct().join(seeds, ["area_id", "origin"]).where(F.col("radius_m") - F.col("d0") >= MIN_WALK_M)
    # an origin has at most four seeds
    by_radius = rows.groupBy("area_id", "origin", "radius_m").agg(F.array_sort(F.collect_set(F.struct("id", "d0"))).alias("s"))
    key = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["id"].cast("string"), F.round(x["d0"], 6).cast("decimal(20,6)").cast("string"))), "|")
    grouped = by_radius.withColumn("seed_key", key).groupBy("area_id", "origin", "seed_key")
    return grouped.agg(F.max("radius_m").alias("max_m"), F.array_sort(F.collect_set("radius_m")).alias("radii"), F.first(F.size("s")).alias("n_seeds"))


def variants(stops: DataFrame, radii: DataFrame, built: DataFrame) -> DataFrame:
    """A row a stop: how many radii were asked, how many gave a polygon and how many stayed empty. ``built``: polygon_key, radius_m of polygons."""
    wanted = stops.join(F.broadcast(radii), "type").select("polygon_key", "type", "radius_m").distinct()
    have = built.select("polygon_key", "radius_m", F.lit(1).alias("have")).distinct()
    rows = wanted.join(have, ["polygon_key", "radius_m"], "left").groupBy("polygon_key", "type")
    return rows.agg(F.count("*").alias("asked"), F.count("have").alias("built"), (F.count("*") - F.count("have")).alias("empty"))


def dataset_rows(stops: DataFrame, radii: DataFrame, encoded: DataFrame) -> DataFrame:
    """type, radius_m, polygon_key, encoded: what each shipped file holds. ``encoded``: polygon_key, radius_m, encoded; shorter than six numbers is nothing."""
    keys = stops.join(F.broadcast(radii), "type").select("type", "radius_m", "polygon_key").distinct()
    return keys.join(encoded.where(F.size("encoded") >= 6), ["polygon_key", "radius_m"]).select("type", "radius_m", "polygon_key", "encoded")


def dataset_outputs(rows: DataFrame, radii: DataFrame) -> DataFrame:
    """A row a file, also of those without polygons: filename, polygons, integers."""
    name = F.concat(F.lit("walksheds-"), F.col("type"), F.lit("-"), F.col("radius_m").cast("bigint").cast("string"), F.lit(".json"))
    got = rows.groupBy("type", "radius_m").agg(F.count("*").alias("polygons"), F.sum(F.size("encoded")).alias("integers"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return radii.join(got, ["type", "radius_m"], "left").select("type", "radius_m", name.alias("filename"), zero("polygons"), zero("integers"))


def shards(counts: DataFrame) -> DataFrame:
    """``counts``: type, stops. Every type that has radii to build, the one with most stops first, equal ones in canonical order: type, stops, pos."""
    spark = counts.sparkSession
    every = spark.createDataFrame([(t, k) for k, t in enumerate(TYPES) if SHIPPED_RADII.get(t)], "type string, ordinal int")
    rows = every.join(counts, "type", "left").select("type", F.coalesce("stops", F.lit(0)).cast("bigint").alias("stops"), "ordinal")
    # there are three types, so their places are found by comparing them
    first = rows.select(F.col("stops").alias("s"), F.col("ordinal").alias("o"))
    ahead = rows.join(F.broadcast(first), F.expr("s > stops or (s = stops and o < ordinal)"), "left")
    return ahead.groupBy("type", "stops", "ordinal").agg(F.count("s").alias("pos")).select("type", "stops", "pos")


def shard_json(counts: DataFrame) -> str:
    return json.dumps({"include": [{"type": r.type} for r in shards(counts).orderBy("pos").collect()]})


def average_ms(total: Column, count: Column) -> Column:
    return F.when(count > 0, half_up(total / count)).otherwise(0).cast("bigint")


def mebibytes(size: Column) -> Column:
    return F.format_string("%.2f", size / F.lit(1_048_576.0))


def seconds(ms: Column) -> Column:
    return F.format_string("%.1fs", ms / F.lit(1000.0))


def radius_summary(radii: dict[str, float]) -> str:
    """The least and the largest radius, one number where they are equal."""
    low, high = min(radii.values()), max(radii.values())
    return f"{low:g} m" if low == high else f"{low:g}–{high:g} m"


def fetch_report(attempts: DataFrame) -> DataFrame:
    """One row of totals over all attempts: attempts, failures, total_ms, max_ms, average_ms and the count by status, failures of the network apart."""
    ms = F.coalesce(F.col("duration_ms"), F.lit(0))
    by = attempts.groupBy(F.coalesce(F.col("status").cast("string"), F.lit("network")).alias("s")).agg(
        F.count("*").alias("n"), F.count_if(~F.col("outcome").eqNullSafe("ok")).alias("bad"), F.sum(ms).alias("ms"), F.max(ms).alias("top"))
    one = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("attempts"), F.coalesce(F.sum("bad"), F.lit(0)).alias("failures"), F.coalesce(F.sum("ms"), F.lit(0)).alias("total_ms"), F.coalesce(F.max("top"), F.lit(0)).alias("max_ms"),
                 F.array_sort(F.collect_list(F.concat_ws("×", "s", F.col("n").cast("string")))).alias("by"))
    return one.select("attempts", "failures", "total_ms", "max_ms", average_ms(F.col("total_ms"), F.col("attempts")).alias("average_ms"), seconds(F.col("max_ms")).alias("max_text"), F.array_join("by", ", ").alias("by_status"))


def step_summary(report: dict) -> str:
    """The report of a build as Markdown lines; parts that are absent are left out."""
    lines = [f"## Build: {'/'.join(report.get('types', ()))} ({report.get('status', 'running')})", ""]
    if report.get("error"):
        lines += [f"> {report['error']}", ""]
    names = (("built", "Stops with polygons"), ("empty", "Empty radius variants"), ("unresolved", "Unresolved stops"), ("passes", "Passes"), ("attempts", "Attempts"), ("failures", "Failed attempts"), ("files", "Files"))
    return "\n".join(lines + [f"- {label}: {report[key]}" for key, label in names if key in report]) + "\n"


def run_passes(batches: Sequence, compute, retries: int = RETRY_PASSES, rest=lambda s: None) -> tuple[list, int]:
    """Run ``compute(batch) -> ok`` over all batches, then again over those that failed, with a rest that grows. (unresolved, passes done).

    A failed batch is tried in a later pass, never within its own.
    """
    left, done = list(batches), 0
    while left and done <= retries:
        if done:
            rest(REST_S * done)
        left = [b for b in left if not compute(b)]
        done += 1
    return left, done
