"""Checks of external JSON before it is used: network payloads and shipped polygon files. One bad part rejects the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmesh.functions.codec import valid_encoding
from footmesh.operators.nested import once
from footmesh.operators.stops import TYPES

# The version of the files, and the largest whole number that a double holds exactly.
VERSION, SAFE = 1, 2**53 - 1

NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))$"
NUMBERS = r"^ARRAY<(VOID|BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))>$"


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def is_number(v: Column) -> Column:
    """A JSON number, not a text that reads like one; absent and null are none."""
    return _kind(v).rlike(NUMBER)


def valid_node(e: Column) -> Column:
    return F.coalesce(_text(e, "type") == "node", F.lit(False)) & is_number(_at(e, "id")) & is_number(_at(e, "lat")) & is_number(_at(e, "lon"))


def _text(v: Column, name: str) -> Column:
    """The field's text if it is a JSON text."""
    return F.when(_kind(_at(v, name)) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def all_texts(v: Column) -> Column:
    """An object (or list) whose values are all texts."""
    values = F.coalesce(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), F.try_variant_get(v, "$", "array<variant>"))
    return F.coalesce(F.forall(values, lambda x: _kind(x) == "STRING"), F.lit(False))


def valid_way(e: Column) -> Column:
    tags = _at(e, "tags")
    return F.coalesce(_text(e, "type") == "way", F.lit(False)) & is_number(_at(e, "id")) & _kind(_at(e, "nodes")).rlike(NUMBERS) & (tags.isNull() | all_texts(tags))


def valid_payload(response: Column) -> Column:
    """The response has a list of elements, each a good node or way; an empty list is good, anything else of it bad rejects all."""
    elements = F.try_variant_get(response, "$.elements", "array<variant>")
    return F.coalesce(F.forall(elements, lambda e: valid_node(e) | valid_way(e)), F.lit(False))


def dataset_valid(v: Column) -> Column:
    """A polygon file: version, a date, whole positive precision, crossings yes or no, a positive radius of each type and only valid polygons."""
    precision = F.try_variant_get(v, "$.precision", "double")
    whole = is_number(_at(v, "precision")) & (precision > 0) & (precision == F.floor(precision)) & (precision <= SAFE)
    date = F.try_to_timestamp(_text(v, "generatedAt")).isNotNull()
    radii = F.lit(True)
    for t in TYPES:
        radii = radii & is_number(F.try_variant_get(v, f"$.radiusByType.{t}", "variant")) & (F.try_variant_get(v, f"$.radiusByType.{t}", "double") > 0)
    polygons = F.map_values(F.try_variant_get(v, "$.polygons", "map<string,variant>"))
    good = F.forall(polygons, lambda p: valid_numbers(p) & F.coalesce(valid_encoding(F.try_variant_get(p, "$", "array<bigint>"), precision), F.lit(False)))
    version = is_number(_at(v, "version")) & (F.try_variant_get(v, "$.version", "double") == VERSION)
    return F.coalesce(version & date & whole & (_kind(_at(v, "allowReasonableStreetCrossings")) == "BOOLEAN") & radii & good, F.lit(False))


def valid_numbers(p: Column) -> Column:
    """A list of whole numbers that doubles hold exactly."""
    return _kind(p).rlike(NUMBERS) & F.forall(F.try_variant_get(p, "$", "array<double>"), lambda x: (x == F.floor(x)) & (F.abs(x) <= SAFE))


def parse_datasets(files: DataFrame, text: str = "text") -> DataFrame:
    """Add ``valid`` and ``polygons`` (array of key, encoded), which is null for a file that is not valid or no JSON."""
    df = files.withColumn("_v", F.try_parse_json(text)).withColumn("valid", dataset_valid(F.col("_v")))
    pair = F.transform(F.map_entries(F.try_variant_get("_v", "$.polygons", "map<string,variant>")), lambda e: F.struct(e["key"].alias("polygon_key"), F.try_variant_get(e["value"], "$", "array<bigint>").alias("encoded")))
    return df.withColumn("polygons", F.when(F.col("valid"), pair)).drop("_v")


def payloads(attempts: DataFrame, response: str = "response") -> DataFrame:
    """Add ``valid`` and ``n_elements`` to attempts; the response is a VARIANT column, null where none came."""
    size = F.coalesce(F.size(F.try_variant_get(response, "$.elements", "array<variant>")), F.lit(-1))
    return attempts.select("*", once(F.col(response), valid_payload).alias("valid"), F.greatest(size, F.lit(0)).alias("n_elements"))
