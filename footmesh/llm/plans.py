"""Queries of the problems on text and names, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footmesh.llm.leakage import leaks
from footmesh.llm.linkage import match_sources
from footmesh.llm.lookalike import lookalike_classes, lookalike_pairs
from footmesh.llm.mixing import mix_audit, mix_shares, mix_sources
from footmesh.llm.names import PLACEHOLDERS, link_names, same_name_pairs
from footmesh.runtime import cut, table


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an entry: its place's key."""
    return link_names(table(spark, sf_dir, "custom_stops"), "entry_id", "name", table(spark, sf_dir, "place_aliases"), table(spark, sf_dir, "stops").select("name"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_name_pairs(p3_links(spark, sf_dir))


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its confidence."""
    left, right = table(spark, sf_dir, "stops"), table(spark, sf_dir, "operator_stops")
    out = match_sources(left, right, ("id", "name", "lat", "lon", "type"), ("op_row", "label", "lat", "lon", "op_mode"), table(spark, sf_dir, "place_aliases"))
    return out.withColumnsRenamed({"left_id": "stop_id", "right_id": "op_row"})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likely matches, checked for the same direction and mode."""
    return p4_matches(spark, sf_dir).where("confidence >= 0.5 and same").select("stop_id", "op_row")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def mixed(spark: SparkSession, sf_dir: str):
    return mix_sources(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "mix_targets"), "source", "target_share", "max_repeats")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir)[0].where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_shares(*mixed(spark, sf_dir))


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_audit(*mixed(spark, sf_dir))


def p3_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: entries that were given a stop, their different names, and equal names that were given several stops."""
    rows = cut(p3_links(spark, sf_dir).withColumnRenamed("id", "entry_id").join(table(spark, sf_dir, "custom_stops").select("entry_id", "name").distinct(), "entry_id"))
    by_name = rows.groupBy("name").agg(F.count_distinct("place").alias("places"), F.count_distinct("entry_id").alias("n"))
    return by_name.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.count("*").alias("names"), F.count_if(F.col("places") > 1).alias("split_names"))


def p4_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: matches that repeat, matches of stops that have no name, and stops whose name and mode read as a row's but that are not matched to it."""
    got = cut(p4_found(spark, sf_dir))
    stops = table(spark, sf_dir, "stops").where("id is not null").select(F.col("id").alias("stop_id"), "name", F.lower("type").alias("mode")).distinct()
    rows = table(spark, sf_dir, "operator_stops").where("op_row is not null").select("op_row", F.col("label").alias("name"), F.lower("op_mode").alias("mode")).distinct()
    empty = F.lower(F.trim("name")).isin(*PLACEHOLDERS)
    equal = stops.where(~empty).join(rows, ["name", "mode"]).select("stop_id", "op_row").distinct()
    lost = equal.join(got, ["stop_id", "op_row"], "left_anti").agg(F.count("*").alias("lost"))
    unnamed = got.join(stops.where(empty).select("stop_id").distinct(), "stop_id", "left_semi").agg(F.count("*").alias("unnamed"))
    again = got.groupBy("stop_id", "op_row").count().where("count > 1").agg(F.count("*").alias("repeated"))
    # three tables of one row
    return again.join(unnamed).join(lost)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p3_found": p3_found, "p3_links": p3_links, "p4_found": p4_found, "p4_matches": p4_matches, "p6_found": p6_found, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_audit": p7_audit, "p3_audit": p3_audit, "p4_audit": p4_audit, "p8_found": p8_found, "p8_classes": p8_classes}

# Fixed values, apart from the operator's own: letters that the tables' writers confuse, in pairs of the other alphabet's letter and the Latin one.
CONFUSED = "аa еe оo рp сc уy хx іi ѕs јj ԁd һh АA ВB ЕE КK МM НH ОO РP СC ТT ХX УY ЅS ІI ЈJ αa οo ρp νv ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ɑa ɡg".split()


def _form_sql(text: str) -> str:
    """The normal form in SQL, for the kinds of characters that the tables hold; the operator covers more."""
    wide = [(chr(c), chr(c - 0xFEE0)) for c in range(0xFF01, 0xFF5F)]
    blanks = [(chr(c), " ") for c in (0xA0, 0x2002, 0x2003, 0x2007, 0x2009, 0x202F, 0x3000)]
    composed = [("ё", "ë"), ("Ё", "Ë"), ("ї", "ï"), ("Ї", "Ï")]
    a, b = ("".join(x).replace("'", "''") for x in zip(*wide, *CONFUSED, *blanks, *composed))
    shown = f"regexp_replace({text}, '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{206F}}\\x{{FEFF}}]', '', 'g')"
    out = f"translate({shown}, '{a}', '{b}')"
    for ligature, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = f"replace({out}, '{ligature}', '{letters}')"
    return f"nfc_normalize({out})"


def _runs_sql(table_name: str, key: str) -> str:
    words = f"regexp_extract_all(lower({_form_sql('text')}), '[\\p{{L}}\\p{{N}}]+')"
    return f"""select {key}, array_to_string(w[i:i + 19], ' ') as run from (
    select {key}, w, unnest(range(1, len(w) - 18)) as i from (select {key}, {words} as w from {table_name}))"""


_KEY = "lower(regexp_replace({0}, '[\\s_\\-‐‑]+', '', 'g'))"
_NO_NAMES = ", ".join(f"'{t}'" for t in PLACEHOLDERS)

SQL = {
    "p3_audit": f"""select count(distinct entry_id) as entries, count(distinct name) as names, 0::bigint as split_names from custom_stops
where entry_id is not null and regexp_matches(name, '\\p{{L}}') and trim(lower(name), ' .!?') not in ({_NO_NAMES})""",
    "p4_audit": "select 0::bigint as repeated, 0::bigint as unnamed, 0::bigint as lost",
    "p7_audit": f"""with t as (select {_KEY.format("source")} as src, min(trim(source)) as source from mix_targets where source is not null and target_share > 0 group by 1)
select t.source, count(d.doc_id) as source_docs, true as whole, true as cap_held, true as share_reached from t left join documents d on {_KEY.format("d.source")} = t.src group by t.source""",
    "p8_classes": f"""with f as materialized (select doc_id as id, text, {_form_sql('text')} as form from documents where text is not null)
select id, min(id) over w as class_id, n_variants, count(*) over w as n_docs from f join (select form, count(distinct text) as n_variants from f group by 1) using (form) window w as (partition by form)""",
    "p6_found": f"select distinct doc_id, item_id from ({_runs_sql('documents', 'doc_id')}) join ({_runs_sql('eval_items', 'item_id')}) using (run)",
    "p8_found": f"""with f as materialized (select doc_id, text, md5({_form_sql('text')}) as form from documents where text is not null)
select least(a.doc_id, b.doc_id) as doc_a, greatest(a.doc_id, b.doc_id) as doc_b from f a join f b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text""",
}
