"""Deeply nested semi-structured records into related flat tables (problem 2).

The text is parsed once into a VARIANT. A merged schema is inferred over all records as (path, kind)
rows; every path that is a list anywhere becomes a level, and so a child table, whose rows carry the
parent's surrogate key and their own ordinal. Levels are exploded recursively on the JVM; Python only
infers the schema, and repairs the few texts that VARIANT refuses (repeated keys in an object).
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footmesh.functions.codec import once
from footmesh.runtime import cut

# Shapes and paths that a task remembers at once while it infers a schema.
SHAPES = 50_000
# The lists that network records have by definition, also where each of them was delivered as a lone value.
ELEMENTS = "$.attempts[].response.elements"
NETWORK_LISTS = ("$.attempts", ELEMENTS, f"{ELEMENTS}[].nodes", f"{ELEMENTS}[].geometry")


@dataclass(frozen=True)
class Level:
    """One list (or map) of the merged schema. ``path`` ends in [] for lists and in {} for maps."""

    path: str
    parent: str
    field: str
    kind: str


def _strict(text: str | None):
    if not text:
        return None
    try:
        value = json.loads(text.lstrip("﻿ \t\r\n"), parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
        return _strict(value) if isinstance(value, str) else value
    except (ValueError, RecursionError):
        return None


def _repaired(texts: pd.Series) -> pd.Series:
    values = texts.map(_strict, na_action="ignore")
    return values.map(lambda v: json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else None)


def repaired(text: Column) -> Column:
    """Complete JSON with repeated keys, the last of which holds; anything else is null."""
    return F.pandas_udf(_repaired, T.StringType())(text)


def _whole(text: Column) -> Column:
    # in brackets, since the parser by itself stops at the end of the first value and ignores what follows
    return once(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>"), lambda vs: F.when(F.size(vs) == 1, vs[0]))


def parsed(df: DataFrame, text: str, out: str = "value") -> DataFrame:
    """Add the text's VARIANT; rows whose text is not complete JSON are left out. A JSON string that holds JSON is opened, a byte order mark skipped."""
    clean = F.regexp_replace(F.col(text), "^[﻿\\s]+", "")
    opened = once(_whole(clean), lambda v: F.when(F.try_variant_get(v, "$", "array<variant>").isNull() & F.try_variant_get(v, "$", "map<string,variant>").isNull(), _whole(F.try_variant_get(v, "$", "string"))).otherwise(v))
    # explode also keeps the optimizer from copying the parse into every later use
    df = df.select("*", F.explode(F.array(opened)).alias("_v"))
    refused = F.when(F.col("_v").isNull() & (F.length(text) > 0), F.col(text))
    df = df.withColumn("_r", repaired(refused))
    return df.select("*", F.explode(F.filter(F.array(F.coalesce("_v", F.try_parse_json("_r"))), lambda v: v.isNotNull())).alias(out)).drop("_v", "_r")


KINDS = {dict: "object", list: "array", type(None): "null", bool: "boolean", str: "string", int: "number", float: "number"}


def merged_schema(df: DataFrame, text: str, maps: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (path, kind, n) over all records; fields named in ``maps`` are open maps and not entered.

    Each task merges its own records first, so the shuffle carries one row a task, path and kind. Objects
    of plain values are counted by their shape, as most look like one seen before.
    """

    def walk(value, path: str, seen: Counter, shapes: Counter) -> None:
        kind = type(value)
        if kind is dict and path.rstrip("[]").rpartition(".")[2] not in maps:
            types = [type(v) for v in value.values()]
            if dict not in types and list not in types:
                shapes[(path, tuple(value), tuple(types))] += 1
                return
            for k, v in value.items():
                walk(v, f"{path}.{k}", seen, shapes)
        elif kind is list:
            types = Counter(map(type, value))
            if dict in types or list in types:
                for v in value:
                    walk(v, path + "[]", seen, shapes)
            else:
                for t, n in types.items():
                    seen[path + "[]", KINDS[t]] += n
        seen[path, KINDS[kind]] += 1

    def rows(seen: Counter, shapes: Counter) -> pd.DataFrame:
        for (path, fields, types), n in shapes.items():
            seen[path, "object"] += n
            for k, t in zip(fields, types):
                seen[f"{path}.{k}", KINDS[t]] += n
        out = pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["path", "kind", "n"])
        seen.clear()
        shapes.clear()
        return out

    def infer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, shapes = Counter(), Counter()
        for frame in frames:
            for body in frame[text]:
                if (value := _strict(body)) is not None:
                    walk(value, "$", seen, shapes)
            if len(seen) + len(shapes) > SHAPES:
                yield rows(seen, shapes)
        if seen or shapes:
            yield rows(seen, shapes)

    return df.select(text).mapInPandas(infer, "path string, kind string, n bigint").groupBy("path", "kind").agg(F.sum("n").alias("n"))


def levels_of(schema: DataFrame, maps: tuple[str, ...] = (), known: tuple[str, ...] = ()) -> list[Level]:
    """The levels of a merged schema, parents first. Which objects are open maps is declared, so a record gives the same tables in every corpus.

    Paths in ``known`` are lists even if the records never have more than a lone value there, and are
    spelled as given even if a value above them, or the whole record, is a list elsewhere.

    Only list and map paths come to the driver: their number is that of the schema's levels.
    """
    named = F.regexp_extract("path", r"([^.\[\]]*)(\[\])*$", 1)
    lists = {r.path for r in schema.where("kind = 'array'").select("path").collect()} | set(known)
    mapped = {r.path.rstrip("[]") for r in schema.where(named.isin(*maps) if maps else F.lit(False)).where("kind in ('object', 'array')").select("path").collect()}
    bare = lambda p: p.replace("[]", "") + "."
    mapped = {m for m in mapped if not any(bare(k).startswith(bare(m)) for k in known)}
    listed = {p for p in lists if p in known or not any(bare(k).startswith(bare(p)) for k in known)}
    out = []
    for path in sorted(lists | mapped, key=lambda p: (p.count("[]"), p)):
        if any(path != m and path.startswith((m + ".", m + "[")) for m in mapped):
            continue
        # a list that is one object elsewhere has its fields under both spellings of the path; the list's spelling is kept
        whole = path
        for at in sorted(listed - {path}, key=len):
            if whole.startswith(at + "."):
                whole = at + "[]" + whole[len(at) :]
        head, _, _ = whole.rpartition("[]")
        field = whole[len(head) + 2 if head else 1 :].lstrip(".")
        level = Level(whole + ("{}" if path in mapped else "[]"), head + "[]" if head else "$", field, "map" if path in mapped else "list")
        if level not in out:
            out.append(level)
    return sorted(out, key=lambda lv: (lv.parent.count("[]"), lv.path))


def as_list(v: Column) -> Column:
    """A VARIANT list's entries; a lone value is a list of one; null, or nothing, is null."""
    lone = F.when(v.isNotNull() & ~F.is_variant_null(v), F.array(v))
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), lone)


def as_map(v: Column) -> Column:
    """A VARIANT object's fields, or those of a list of k/v objects: array of (key, value), keys distinct, nulls left out."""
    pair = "array<struct<key: string, value: variant>>"
    fields = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")).cast(pair)
    listed = F.transform(
        F.try_variant_get(v, "$", "array<variant>"),
        lambda x: F.struct(F.try_variant_get(x, "$.k", "string").alias("key"), F.try_variant_get(x, "$.v", "variant").alias("value")),
    ).cast(pair)
    kept = F.filter(F.coalesce(fields, listed), lambda e: e["key"].isNotNull() & e["value"].isNotNull() & ~F.is_variant_null(e["value"]))
    return kept


def number_text(v: Column) -> Column:
    """A number, quoted or not, as plain digits; any other text as it is; null and empty text are null."""
    text = F.trim(F.try_variant_get(v, "$", "string"))
    return once(text, lambda t: F.when(t.rlike(r"^[+-]?\d+(\.0*)?$"), t.try_cast("decimal(38,0)").cast("string")).otherwise(F.nullif(t, F.lit(""))))


def child_level(df: DataFrame, level: Level, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Explode one level of ``df``: its key columns ``keep``, the ordinal ``ord``, and ``value`` (maps also ``key``)."""
    v = F.col(value)
    for name in level.field.split(".") if level.field else ():
        v = F.try_variant_get(v, "$." + name, "variant") if re.fullmatch(r"\w+", name) else F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(name))
    if level.kind == "map":
        return df.select(*keep, F.posexplode(as_map(v)).alias("ord", "_e")).select(*keep, "ord", "_e.key", "_e.value")
    return df.select(*keep, F.posexplode(as_list(v)).alias("ord", "value"))


def flatten(df: DataFrame, key: str, text: str, maps: tuple[str, ...] = (), order: str | None = None, known: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Tables by level path: "$" with (key, value), children with (parent_key, ord, row_key, value).

    ``row_key`` is ``parent_key/ordinal`` from the record's key down, so any child row leads to its
    element, attempt and record. A record delivered repeatedly counts once (the earliest by ``order``
    whose text is complete). Incomplete or missing texts and null keys give no rows. Ordinals start at
    0 and count null entries, which give no row. An empty table has only "$" and the ``known`` lists.
    A table with several children is made once.
    """
    levels = levels_of(cut(merged_schema(df, text, maps)), maps, known)
    kept = lambda path, rows: cut(rows) if sum(lv.parent == path for lv in levels) > 1 else rows
    tables = {"$": kept("$", one_each(df, key, text, order))}
    for level in levels:
        parent = tables.get(level.parent)
        if parent is None:
            continue
        rows = child_level(parent.select(F.col("row_key").alias("parent_key"), "value"), level, keep=("parent_key",))
        rows = rows.where(F.col("value").isNotNull() & ~F.is_variant_null("value"))
        tables[level.path] = kept(level.path, rows.withColumn("row_key", F.concat_ws("/", "parent_key", F.col("ord").cast("string"))))
    return tables


def one_each(df: DataFrame, key: str, text: str, order: str | None = None) -> DataFrame:
    """(row_key, value): each record once, parsed, texts that are not complete JSON left out."""
    at = F.col(order) if order else F.lit(0)
    rows = parsed(df.select(F.col(key).alias("_k"), at.alias("_at"), F.col(text).alias("_t")).where("_k is not null"), "_t")
    # partial aggregation keeps one delivery a task and key
    last = rows.groupBy("_k").agg(F.min_by("value", F.struct("_at", F.xxhash64("_t"))).alias("value"))
    return last.select(F.col("_k").cast("string").alias("row_key"), "value")


def network_rows(responses: DataFrame) -> DataFrame:
    """The rows of nodes, ways, references, tags and geometry, from the flat tables of their levels."""
    tables = flatten(responses, "record_id", "body", ("tags",), "received_at", NETWORK_LISTS)
    kind = F.try_variant_get("value", "$.type", "string")
    elem = tables[f"{ELEMENTS}[]"].select("row_key", kind.alias("child_kind"), number_text(F.try_variant_get("value", "$.id", "variant")).alias("child_key"))
    elem = elem.where(F.col("child_kind").isin("node", "way") & F.col("child_key").isNotNull())

    def children(path: str, name: str, key: Column) -> DataFrame:
        return tables[path].select(F.col("parent_key").alias("row_key"), F.lit(name).alias("child_kind"), key.alias("child_key")).where("child_key is not null")

    rows = children(f"{ELEMENTS}[].nodes[]", "ref", F.concat(F.col("ord").cast("string"), F.lit(":"), number_text(F.col("value"))))
    rows = rows.unionByName(children(f"{ELEMENTS}[].geometry[]", "geom", F.col("ord").cast("string")))
    if f"{ELEMENTS}[].tags{{}}" in tables:
        rows = rows.unionByName(children(f"{ELEMENTS}[].tags{{}}", "tag", F.col("key")).distinct())
    rows = elem.unionByName(rows.join(elem.select("row_key").hint("merge"), "row_key", "left_semi"))
    at = F.split("row_key", "/")
    return rows.select(at[0].cast("bigint").alias("record_id"), at[1].cast("int").alias("attempt_no"), at[2].cast("int").alias("elem_ord"), "child_kind", "child_key")
