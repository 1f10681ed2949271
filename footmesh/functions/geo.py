"""Geometry as Column expressions: all of it stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radii in metres and metres a degree.
EARTH_RADIUS_M = 6_371_000.0
CIRCLE_RADIUS_M = 6_371_008.8
METERS_PER_DEGREE = 111_320.0
MIN_LON_SCALE = 0.2


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def lon_scale(lat: Column) -> Column:
    """Cosine of the latitude, at least 0.2."""
    return F.greatest(F.lit(MIN_LON_SCALE), F.cos(F.radians(lat)))


def meters_per_lon_degree(lat: Column) -> Column:
    return F.lit(METERS_PER_DEGREE) * lon_scale(lat)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres in the arcsine form, unclamped; null in, null out."""
    dlat, dlon = F.radians(lat2) - F.radians(lat1), F.radians(lon2) - F.radians(lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(h))


def present(*cols: Column) -> Column:
    """All given numbers are there: neither null nor NaN."""
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull() & ~F.isnan(c)
    return out


def finite(*cols: Column) -> Column:
    """All given numbers are there and finite."""
    out = present(*cols)
    for c in cols:
        out = out & (F.abs(c) != float("inf"))
    return out


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)
