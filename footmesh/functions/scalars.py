"""Scalar rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from footmesh.functions.geo import CIRCLE_RADIUS_M, METERS_PER_DEGREE, meters_per_lon_degree

# Fixed values, in metres.
RADIUS_MIN, RADIUS_MAX, RADIUS_STEP = 100, 2000, 50
BUCKETS = (300, 600, 1200, 2400, 5000)
PADDING_M = 80


def half_up(c: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(c + 0.5)


def clamp_radius(value: Column, fallback: Column) -> Column:
    """To the step, between the bounds; null, NaN, infinite and texts that are no number give the fallback as it is."""
    number = F.when(F.trim(value.cast("string")).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(value.cast("string"))).try_cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    stepped = half_up(number / RADIUS_STEP) * RADIUS_STEP
    return F.when(bad, fallback).otherwise(F.least(F.lit(float(RADIUS_MAX)), F.greatest(F.lit(float(RADIUS_MIN)), stepped.cast("double"))))


def radius_bucket(radius: Column) -> Column:
    out = F.when(radius <= BUCKETS[0], float(BUCKETS[0]))
    for b in BUCKETS[1:]:
        out = out.when(radius <= b, float(b))
    return out.when(radius.isNotNull(), F.greatest(radius, F.lit(float(BUCKETS[-1]))))


def outward(c: Column, up: bool, decimals: int = 3) -> Column:
    scale = 10**decimals
    return (F.ceil(c * scale) if up else F.floor(c * scale)).cast("double") / scale


def pad_box(south: Column, west: Column, north: Column, east: Column, metres: Column) -> list[Column]:
    """The box wider by so many metres on each side, by the longitude scale of its poleward end."""
    d = metres / METERS_PER_DEGREE
    s, n = south - d, north + d
    across = metres / meters_per_lon_degree(F.greatest(F.abs(s), F.abs(n)))
    return [s.alias("south"), (west - across).alias("west"), n.alias("north"), (east + across).alias("east")]


def box_area_m2(south: Column, west: Column, north: Column, east: Column) -> Column:
    height = F.greatest(F.lit(0.0), north - south) * METERS_PER_DEGREE
    return height * F.greatest(F.lit(0.0), east - west) * meters_per_lon_degree((south + north) / 2)


def circle(lat: Column, lon: Column, radius: Column, segments: int = 64) -> Column:
    """A closed geodesic ring, longitude first: array<struct<lon, lat>>."""
    angle, phi = radius / CIRCLE_RADIUS_M, F.radians(lat)

    def at(i: Column) -> Column:
        bearing = i * (2 * 3.141592653589793 / segments)
        y = F.asin(F.sin(phi) * F.cos(angle) + F.cos(phi) * F.sin(angle) * F.cos(bearing))
        x = F.radians(lon) + F.atan2(F.sin(bearing) * F.sin(angle) * F.cos(phi), F.cos(angle) - F.sin(phi) * F.sin(y))
        return F.struct(F.degrees(x).alias("lon"), F.degrees(y).alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(segments)), at)


def retry_after_ms(value: Column, now_ms: Column) -> Column:
    """Seconds, or an HTTP date, as milliseconds to wait, never below 0; null where it is neither."""
    text = F.trim(value)
    seconds = F.when(text.rlike(r"^\d+(\.\d+)?$"), text).try_cast("double") * 1000
    date = F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    return F.when(F.coalesce(seconds, F.unix_millis(date).cast("double")).isNotNull(), F.greatest(F.lit(0.0), F.coalesce(seconds, F.unix_millis(date).cast("double") - now_ms)))
