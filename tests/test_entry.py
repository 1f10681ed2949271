"""Queries against their SQL on the smallest tables, and empty tables through all of the core's problem queries."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUICK = ("p1_found", "p2_found", "p5_found", "p5_region", "graph_edges", "graph_index", "stop_dedup", "batch_areas", "stop_keys", "request_bursts", "http_endpoints", "http_metrics", "cache_kept", "etl_stops", "stop_sorted", "serve_lookup", "serve_settle", "net_payloads", "settings_changed", "view_current", "build_traversals", "cache_evictions", "walk_convex")


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v
    return sorted(repr(tuple(clean(r[i]) for i in order)) for r in values)


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, small, name):
    con = duckdb.connect()
    for file in os.listdir(small):
        con.execute(f"create view {file[:-8]} as select * from '{small}/{file}'")
    df = entry.queries()[name](spark, small)
    got = con.execute(entry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in got.description], got.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p5_found", "p5_region"])
def test_empty_tables(spark, small, tmp_path, name):
    for file in os.listdir(small):
        spark.read.parquet(f"{small}/{file}").limit(0).write.parquet(f"{tmp_path}/{file}")
    assert entry.queries()[name](spark, str(tmp_path)).count() == 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
