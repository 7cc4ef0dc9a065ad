"""JSON node tables: order, numbers, repeated keys, depth; detection of what hangs on details."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import detect, json_tree, outline, schema_ir, trees


def one(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_nodes_keep_order_numbers_and_sizes(spark):
    text = '{"b":1.0,"a":[10,{"z":1e3,"y":null}],"b2":true,"b":2.50,"t":"\\ud800x"}'
    rows = json_tree.json_nodes(one(spark, text, "nope", None, "[]", "NaN")).filter("doc_id = 0").orderBy("node").collect()
    got = [(r.key, r.kind, r.value, r.parent, r["size"], r.place) for r in rows]
    assert got == [
        (None, "object", None, -1, 9, []), ("b", "float", "2.5", 0, 1, [0]), ("a", "array", None, 0, 5, [1]), (None, "integer", "10", 2, 1, [1, 0]), (None, "object", None, 2, 3, [1, 1]),
        ("z", "float", "1000.0", 4, 1, [1, 1, 0]), ("y", "null", "null", 4, 1, [1, 1, 1]), ("b2", "boolean", "true", 0, 1, [2]), ("t", "string", "?x", 0, 1, [3]),
    ]
    assert {r.doc_id for r in json_tree.json_nodes(one(spark, "nope", None, "", "{")).collect()} == set()


def test_many_texts_and_nodes_leave_in_bounded_batches(spark):
    wide, deep = json.dumps(list(range(60_000))), "[" * 400 + "]" * 400
    rows = json_tree.json_nodes(one(spark, wide, deep, *["[1]"] * 50)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in rows} == {0: 60_001, 1: 400} | {i: 2 for i in range(2, 52)}


def test_outline_types_and_previews(spark):
    text = '{"n":1.0,"m":10,"k":1,"k":2,"deep":[[[[["x  y"]]]]],"none":[[]],"mix":[{"a":1},2]}'
    got = {r.name: (r.type, r.example) for r in outline.json_outline(one(spark, text)).filter("depth = 2").collect()}
    assert got == {"n": ("float", "1.0"), "m": ("integer", "10"), "k": ("integer", "2"), "deep": ("list", "[[[[[x y, ...], ...], ...], ...], ...]"), "none": ("list", "[[], ...]"), "mix": ("list", "[{...}, ...]")}
    flat = outline.json_outline(one(spark, text), sample_lists=False).collect()
    assert {r.example for r in flat if r.type == "list"} == {"[...]"} and max(r.depth for r in flat) == 2


def test_fields_come_in_the_order_of_the_file(spark):
    text = '{"title":"T","required":["z"],"properties":{"z":{"type":"string"},"a/b":{"$ref":"#/properties/z"},"m":{"type":"array"},"a":{"oneOf":[{"type":"integer"},true,{"title":"U","enum":[1]}]}}}'
    assert [r.name for r in outline.schema_fields(one(spark, text)).orderBy("pos").collect()] == ["z", "a/b", "m", "a"]
    out = schema_ir.json_schema_ir(spark.createDataFrame([("b", "t.json", text)], "bundle string, path string, text string"))
    fields = [(r.name, r.type_prim or r.type_ref, r.card_max) for r in out["fields"].filter("entity_id = 'T'").orderBy("pos").collect()]
    assert fields == [("z", "string", 1), ("a/b", "string", 1), ("m", "T.m", None), ("a", "T.a", 1)]
    assert sorted((r.entity_id, r.role, r.pos, r.target, r.is_ref) for r in out["relations"].collect()) == [("T.a", "choice", 0, "integer", False), ("T.a", "choice", 1, "any", False), ("T.a", "choice", 2, "U", True), ("T.m", "element", 0, "T.m.items", True)]


@pytest.mark.parametrize(("text", "kind"), [
    (f'<!DOCTYPE s [<!ENTITY x "y">]><s:schema xmlns:s="{detect.XSD}"/>', None), (f'<?xml version="1.0"?><!DOCTYPE s [<!ENTITY x "y">]> <!-- <q> --> <s:schema xmlns:s="{detect.XSD}"/>', "xsd_schema"),
    (f"<a.b:Schema x='1>0'\n xmlns:a.b = '{detect.XSD}'>", "xsd_schema"), (f'<aXb:schema xmlns:a.b="{detect.XSD}">', None), (f'<schema myxmlns="{detect.XSD}">', "xml_instance"), (f'[1, "<schema xmlns=\'{detect.XSD}\'>"]', "json_instance"),
    ('{"a":1,"a":', None), ('{"type":"object","properties":1,"properties":{}}', "json_schema"),
])
def test_kind_hangs_on_the_root(spark, text, kind):
    assert detect.detect_kind(one(spark, text)).first().kind == kind


def test_json_has_nothing_behind_its_value(spark):
    none = ["4397110767823743 +1 (654) 555-4136 That the as the.", "-12 a", '"a" b', '"a"], ["b"', "1, 2", '{"a":1} x', "[1] [2]", "null,", ""]
    instance = [" 12 ", '"a"\n', "null", '{"a":1}\n', "[1, 2]", '{"a":1,"a":2} ']
    kinds = dict.fromkeys(none) | dict.fromkeys(instance, "json_instance") | {"true\nk: v": "yaml_instance", '{"type":"object","required":[]} ': "json_schema"}
    rows = detect.detect_kind(one(spark, *kinds)).withColumn("json", detect.looks_like_json(F.col("text"))).collect()
    assert {r.text: r.kind for r in rows} == kinds
    assert {r.text for r in rows if r.json} == {t for t, k in kinds.items() if k and k.startswith("json")}


def test_fields_meet_their_types_without_broadcasts(spark):
    files = spark.createDataFrame([("b", "t.json", '{"title":"T","properties":{"a":{"$ref":"#/properties/z"},"z":{"type":"string"}}}')], "bundle string, path string, text string")
    out = schema_ir.json_schema_ir(files)["fields"]
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.name, r.type_prim) for r in out.collect()) == [("a", "string"), ("z", "string")]


def test_xml_is_parsed_once_and_only_first_siblings_leave(spark):
    docs = one(spark, '<a x="1">' + "<b><c>1</c><c>2</c></b>" * 500 + "<d>t</d></a>")
    assert trees.xml_nodes(docs).count() == 5
    out = trees.xml_outline(docs)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = [(r.ord, r.depth, r.name, r.type, r.example) for r in out.orderBy("ord").collect()]
    assert rows == [
        ([0], 1, "a", "object", None), ([0, 0], 2, "@x", "integer", "1"), ([0, 1], 2, "b", "list", "[{...}, ...]"), ([0, 1, 0], 3, "items", "object", None),
        ([0, 1, 0, 0], 4, "c", "list", "[1, ...]"), ([0, 1, 0, 0, 0], 5, "items", "integer", "1"), ([0, 501], 2, "d", "string", "t"),
    ]
