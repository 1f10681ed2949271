"""Keys, and polygons as delta-encoded integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRECISION = 100_000


def plain_number(c: Column) -> Column:
    """A double as text, with no exponent and no trailing zeros: 49.0 is 49."""
    text = F.regexp_replace(c.cast("decimal(38,15)").cast("string"), r"0+$", "")
    return F.regexp_replace(text, r"\.$", "")


def to_fixed(c: Column, digits: int) -> Column:
    """A double with so many digits after the point, rounded by its exact binary value (halves away from zero), as in JSON-style number printing.

    Formatters on the JVM round the shortest decimal text instead, which differs on what only looks like a tie.
    """
    size = F.abs(c)
    whole = F.floor(size)
    exact = ((size - whole) * F.lit(float(2**52))).cast("decimal(20,0)")
    k = F.call_function("div", exact * F.lit(10**digits).cast("decimal(10,0)") + F.lit(2**51).cast("decimal(20,0)"), F.lit(2**52).cast("decimal(20,0)"))
    text = F.concat((whole + F.floor(k / 10**digits)).cast("bigint").cast("string"), F.lit("."), F.lpad((k % 10**digits).cast("string"), digits, "0"))
    return F.concat(F.when(c < 0, "-").otherwise(""), text)


def result_key(id_: Column, mode: Column | str, radius: Column, lat: Column | None = None, lon: Column | None = None) -> Column:
    """id:v2:mode:radius, with the position to six decimals where it is given."""
    parts = [id_, F.lit("v2"), F.lit(mode) if isinstance(mode, str) else mode, plain_number(radius)]
    if lat is not None and lon is not None:
        parts += [to_fixed(lat, 6), to_fixed(lon, 6)]
    return F.concat_ws(":", *parts)


def polygon_key(id_: Column, type_: Column, lat: Column, lon: Column) -> Column:
    return F.concat_ws(":", id_, type_, plain_number(lat), plain_number(lon))


def type_of_key(key: Column) -> Column:
    """The type is third from the end, as ids may hold colons."""
    return F.try_element_at(F.split(key, ":"), F.lit(-3))


def once(value: Column, use) -> Column:
    """Bind a costly expression to a lambda variable, so that it is computed once however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def encode(polygon: Column, precision: int = PRECISION) -> Column:
    """array<struct<lat, lon>> -> differences of the rounded coordinates, latitude and longitude in turn. Halves round up."""
    q = lambda c: F.floor(c * precision + 0.5).cast("bigint")
    flat = F.flatten(F.transform(polygon, lambda p: F.array(q(p["lat"]), q(p["lon"]))))
    return once(flat, lambda f: F.transform(f, lambda v, i: F.when(i < 2, v).otherwise(v - F.get(f, i - 2))))


def sums(encoded: Column) -> Column:
    """Running positions of an encoded array as (a, b) pairs of whole numbers; a number without a partner is left out.

    The pairs are summed by doubling strides, so the work grows with n log n and no array is grown entry by entry.
    """
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(encoded) / 2).cast("int") - 1), lambda i: F.struct(F.get(encoded, i * 2).alias("a"), F.get(encoded, i * 2 + 1).alias("b")))
    zero = F.lit(0).cast("bigint")

    def stride(xs: Column, s: Column) -> Column:
        return F.transform(xs, lambda p, i: F.struct((p["a"] + F.coalesce(F.get(xs, i - s)["a"], zero)).alias("a"), (p["b"] + F.coalesce(F.get(xs, i - s)["b"], zero)).alias("b")))

    # strides 1, 2, 4, ... below the number of pairs
    steps = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(1), F.size(encoded)))).cast("int"))), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.when(F.size(encoded) >= 2, F.aggregate(steps, pairs, stride)).otherwise(F.array().cast("array<struct<a: bigint, b: bigint>>"))


def decode(encoded: Column, precision: int | Column = PRECISION) -> Column:
    """The polygon of an encoded array; a number without a partner is left out."""
    return F.transform(sums(encoded), lambda p: F.struct((p["a"] / precision).alias("lat"), (p["b"] / precision).alias("lon")))


def valid_encoding(encoded: Column, precision: int | Column = PRECISION) -> Column:
    """At least three points, an even count, and every position on the globe."""
    return (F.size(encoded) >= 6) & (F.size(encoded) % 2 == 0) & F.forall(decode(encoded, precision), lambda p: (F.abs(p["lat"]) <= 90) & (F.abs(p["lon"]) <= 180))
