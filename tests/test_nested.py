import json

from footmesh.operators import nested as N

DOC = {
    "attempts": [
        None,
        {"response": None},
        {"response": {"elements": [
            None,
            {"type": "node", "id": "007", "lat": 1.0, "lon": 2.0, "tags": {"a": 1, "b": None}},
            {"type": "way", "id": 5, "nodes": [7, None, "8"], "tags": [{"k": "x", "v": "1"}, {"k": "y", "v": None}], "geometry": [None, {"lat": 1, "lon": 2}]},
            {"type": "relation", "id": 9, "tags": {"a": 1}},
            {"type": "node", "lat": 1.0},
        ]}},
        {"response": {"elements": {"type": "way", "id": 6, "nodes": 7}}},
    ]
}
EXPECTED = {
    (1, 2, 1, "node", "7"), (1, 2, 1, "tag", "a"), (1, 2, 2, "way", "5"), (1, 2, 2, "ref", "0:7"), (1, 2, 2, "ref", "2:8"), (1, 2, 2, "tag", "x"), (1, 2, 2, "geom", "1"),
    (1, 3, 0, "way", "6"), (1, 3, 0, "ref", "0:7"),
}


def rows(spark, bodies):
    df = spark.createDataFrame([(k, f"2025-01-0{i + 1}", b, "x") for i, (k, b) in enumerate(bodies)], "record_id bigint, received_at string, body string, value string")
    return sorted(tuple(r) for r in N.network_rows(df).collect())


def test_shapes(spark):
    text = json.dumps(DOC)
    assert set(rows(spark, [(1, text)])) == EXPECTED
    # repeated, encoded twice, with a byte order mark, with white space
    assert set(rows(spark, [(1, text), (1, text)])) == EXPECTED
    assert set(rows(spark, [(1, json.dumps(text))])) == EXPECTED
    assert set(rows(spark, [(1, "﻿" + json.dumps(DOC, indent=1))])) == EXPECTED


def test_incomplete_bodies_give_nothing(spark):
    text = json.dumps(DOC)
    assert rows(spark, [(1, text[:-1]), (2, text + "x"), (3, None), (4, ""), (5, "null"), (6, "[]"), (7, text + text), (8, "{'a': 1}"), (None, text)]) == []


def test_repeated_keys_last_holds(spark):
    text = '{"attempts": [], "attempts": [{"response": {"elements": [{"type": "node", "id": 1, "id": 2}]}}]}'
    good = json.dumps(DOC)
    assert (2, 0, 0, "node", "2") in rows(spark, [(1, good), (2, text)])


def test_empty_table(spark):
    assert rows(spark, []) == []


def test_long_list(spark):
    doc = {"attempts": {"response": {"elements": [{"type": "way", "id": 1, "nodes": list(range(20_000))}]}}}
    got = rows(spark, [(1, json.dumps({"attempts": [doc["attempts"]]}))])
    assert len(got) == 20_001


def test_tables_lead_to_parents(spark):
    df = spark.createDataFrame([("r", json.dumps({"a": [{"b": [1, 2]}, {"b": 3}, {}], "m": {"x": {"y": [True]}}}))], "k string, t string")
    tables = N.flatten(df, "k", "t", ("m",))
    assert set(tables) == {"$", "$.a[]", "$.a[].b[]", "$.m{}"}
    assert sorted(r.row_key for r in tables["$.a[].b[]"].collect()) == ["r/0/0", "r/0/1", "r/1/0"]
    assert [(r.parent_key, r.key) for r in tables["$.m{}"].collect()] == [("r", "x")]


def test_merged_schema(spark):
    df = spark.createDataFrame([(json.dumps({"a": [1, "x"]}),), (json.dumps({"a": None}),), ("broken",)], "t string")
    got = {(r.path, r.kind): r.n for r in N.merged_schema(df, "t").collect()}
    assert got == {("$", "object"): 2, ("$.a", "array"): 1, ("$.a", "null"): 1, ("$.a[]", "number"): 1, ("$.a[]", "string"): 1}


def test_lone_values_need_no_list_elsewhere(spark):
    way = {"type": "way", "id": 6, "nodes": 7, "geometry": {"lat": 1, "lon": 2}, "tags": {"a": 1}}
    lone = json.dumps({"attempts": {"response": {"elements": way}}})
    want = [(1, 0, 0, "geom", "0"), (1, 0, 0, "ref", "0:7"), (1, 0, 0, "tag", "a"), (1, 0, 0, "way", "6")]
    assert rows(spark, [(1, lone)]) == want
    # lists of the same names at other paths don't stand for these
    other = json.dumps({"attempts": {"response": {"elements": {**way, "x": {"elements": [{"nodes": [1]}], "attempts": [1]}}}}, "z": {"elements": [1], "a b": {"c[": [1]}}})
    assert rows(spark, [(1, other)]) == want
    assert rows(spark, [(1, lone), (2, json.dumps({"attempts": [{"response": {"elements": [way]}}], **{f"k{k}": 1 for k in range(300)}}))]) == want + [(2, *w[1:]) for w in want]
    above = [(2, json.dumps([{"attempts": [1]}])), (3, json.dumps({"attempts": [{"response": [{"elements": [way]}]}, [way]]}))]
    assert rows(spark, [(1, lone), *above]) == want
