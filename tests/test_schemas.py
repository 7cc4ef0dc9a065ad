"""Outlines and entity tables of schema files, worked out by hand from the rules."""

import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from conftest import SF
from millrace.operators import classes, convert, detect, docs, graph, schema_ir, schemas
from millrace.sources import files

JSON_SCHEMA = """{"title":"My Doc","type":"object","description":" a\\n b ","required":["b","a"],"$defs":{"z":{"type":"string","enum":["x",1,null]},"y":{"$ref":"#/$defs/z"}},
"properties":{"b":{"type":["null","integer"],"minimum":1,"default":2},"a":{"items":[{"type":"string"},{"const":1}]},"c":{"additionalProperties":{"type":"number"},"properties":{"q":{}}}},
"patternProperties":{"^x":{"type":"string"}},"allOf":[{"type":"object"},true,{"not":{"type":"null"}}]}"""
JSON_MARKDOWN = """# my doc
- description: a b
- type: object
- required: a, b

## $defs

### y
- type: ref #/$defs/z
- constraint: $ref=#/$defs/z

### z
- type: string
- enums: x, 1, none

## a
- type: array
- required: true

### items[0]
- type: string

### items[1]
- type: const

## b
- type: integer | null
- constraint: minimum=1; default=2
- required: true

## c
- type: object
- constraint: additionalproperties=schema
- required: false

### q
- required: false

### additionalproperties
- type: number

## patternproperties: ^x
- type: string

## allof

### allof[0]
- type: object

### allof[2]
#### not
- type: null
"""
XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:t="urn:t" targetNamespace="urn:t">
<xs:element name="root" type="t:T"/><xs:element name="other"><xs:complexType><xs:all><xs:element name="deep"><xs:simpleType><xs:restriction base="xs:string"><xs:pattern value="a+"/></xs:restriction></xs:simpleType></xs:element></xs:all></xs:complexType></xs:element>
<xs:complexType name="T"><xs:sequence><xs:element name="kid" type="t:T" minOccurs="0" maxOccurs="unbounded"/><xs:element ref="t:other"/><xs:element name="when" type="xs:date"/><xs:element name="odd" type="zz:thing"/></xs:sequence></xs:complexType>
<xs:complexType name="U"><xs:complexContent><xs:extension base="t:T"/></xs:complexContent></xs:complexType></xs:schema>"""


def test_json_schema_markdown(spark):
    df = spark.createDataFrame([("1", JSON_SCHEMA), ("2", "[1]"), ("3", "nope"), ("4", None)], "doc_id string, text string")
    assert [tuple(r) for r in schemas.rendered(schemas.json_schema_outline(df)).collect()] == [("1", JSON_MARKDOWN)]


def test_xsd_type_is_not_expanded_inside_itself(spark):
    df = spark.createDataFrame([("1", XSD), ("2", "<a/>"), ("3", "<xs:schema"), ("4", None)], "doc_id string, text string")
    rows = schemas.xsd_outline(df).orderBy("ord").collect()
    names = [("  " * (r.depth - 1)) + r.name for r in rows]
    assert names[:12] == ["urn:t", "  elements", "    other", "      complextype", "        all", "          deep", "            simpletype", "              restriction", "    root", "      type: T", "        sequence", "          kid"]
    assert sum(n.strip() == "type: T" for n in names) == 1 and {r.doc_id for r in rows} == {"1"}


def test_xsd_entities(spark):
    out = schema_ir.xsd_ir(spark.createDataFrame([("b", "x.xsd", XSD, "s")], "bundle string, path string, text string, source_id string"))
    kinds = {r.entity_id: r.kind for r in out["entities"].collect()}
    assert kinds == {"s:urn:t#T": "object", "s:urn:t#U": "object", "s:urn:t#other": "object", "s:urn:t#s:urn:t#other.deep": "string", "s:urn:t#s:urn:t#T.other": "object", "s:urn:t#s:urn:t#s:urn:t#T.other.deep": "string"}
    fields = {r.name: (r.type_prim, r.type_ref, r.card_min, r.card_max) for r in out["fields"].filter("entity_id = 's:urn:t#T'").collect()}
    assert fields == {"kid": (None, "s:urn:t#T", 0, None), "other": (None, "s:urn:t#s:urn:t#T.other", 1, 1), "when": ("string", None, 1, 1), "odd": ("string", None, 1, 1)}
    assert [(r.entity_id, r.target) for r in out["relations"].collect()] == [("s:urn:t#U", "s:urn:t#T")]


def test_json_schema_entities_follow_references(spark):
    a = """{"title":"Order","properties":{"id":{"type":"string","maxLength":9},"lines":{"type":"array","items":{"$ref":"sub/line.json#/definitions/line"}},"x":{"$ref":"http://e.org/x"},"me":{"$ref":"#"},
    "u":{"oneOf":[{"type":"string"},{"$ref":"#/definitions/who"}]}},"definitions":{"who":{"enum":["a"],"type":"string"}}}"""
    b = """{"definitions":{"line":{"type":"object","properties":{"qty":{"type":"integer"}}},"loop":{"$ref":"#/definitions/loop"}},"properties":{"l":{"$ref":"#/definitions/loop"}}}"""
    out = schema_ir.json_schema_ir(spark.createDataFrame([("b", "order.json", a), ("b", "sub/line.json", b), ("b", "bad.json", "{")], "bundle string, path string, text string"))
    fields = {(r.entity_id, r.name): r.type_ref or r.type_prim for r in out["fields"].collect()}
    assert fields == {("Order", "id"): "Order.id", ("Order", "lines"): "Order.lines", ("Order", "x"): "any", ("Order", "me"): "Order", ("Order", "u"): "Order.u", ("line#/definitions/line", "qty"): "integer", ("line", "l"): "any"}
    assert sorted((r.entity_id, r.role, r.target, r.is_ref) for r in out["relations"].collect()) == [("Order.lines", "element", "line#/definitions/line", True), ("Order.u", "choice", "order#/definitions/who", True), ("Order.u", "choice", "string", False)]
    assert sorted(r.ref for r in out["unresolved"].collect()) == ["#/definitions/loop", "http://e.org/x"]


def test_model_classes(spark):
    text = "from pydantic import BaseModel\nclass B(BaseModel):  # note\n    a: 'list[A]'\n    class C(BaseModel):\n        x: int\nclass A(BaseModel):\n    n: int\nclass P(BaseModel):\n    q: Q\nclass Q(BaseModel):\n    p: P\nclass Z: pass\n"
    df = spark.createDataFrame([("1", detect.KINDS[0], text), ("2", detect.KINDS[0], "class ("), ("3", detect.KINDS[0], None)], "doc_id string, kind string, text string")
    rows = classes.class_outline(df)
    assert {(r.name, r["round"]) for r in classes.class_dependency_order(rows).collect()} == {("A", 0), ("B", 1), ("P", 2), ("Q", 3)}
    (md,) = classes.render_classes(rows).collect()
    assert md.markdown.startswith("# pydantic models\n\n## a\n```python\nclass a(basemodel):\n    n: int\n```\n\n## b\n```python\nclass b(basemodel):") and "### c\n" in md.markdown and "note" not in md.markdown


def test_conversion_takes_each_text_once(spark):
    rows = [("j", '{"a": 1}', None), ("s", JSON_SCHEMA, None), ("x", XSD, None), ("m", "<a><b>1</b></a>", None), ("y", "k: v", None), ("p", "from dataclasses import dataclass\n@dataclass\nclass A:\n    x: int\n", None), ("n", "plain", None), ("b", "<a>", None), ("e", None, "bad payload"), ("0", "", None)]
    done, rejects = convert.convert_to_markdown(spark.createDataFrame(rows, "doc_id string, text string, error string"))
    assert {r.doc_id: r.kind for r in done.collect()} == {"j": "json_instance", "s": "json_schema", "x": "xsd_schema", "m": "xml_instance", "y": "yaml_instance", "p": "dataclass_model"}
    assert {r.doc_id: r.status for r in rejects.collect()} == {"n": 415, "b": 500, "e": 400, "0": 415}


def test_packing_closes_after_the_field_that_fills(spark):
    rows = [("b", "e", i, f"f{i}", "string", None, None, False, 0, 1) for i in range(1, 6)]
    f = spark.createDataFrame(rows, "bundle string, entity_id string, pos int, name string, type_prim string, type_ref string, description string, required boolean, card_min int, card_max int")
    # each line and its line feed have 21 characters: the third passes 50
    assert [r.part for r in docs.pack_fields(f, 30, 50).orderBy("pos").collect()] == [1, 1, 1, 2, 2]


def test_closure_runs_to_its_end(spark):
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)], "src string, dst string")
    assert graph.reachable(chain, spark.createDataFrame([("0",)], "node string")).count() == 7


def test_expansion_without_a_limit(spark):
    edges = spark.createDataFrame([("a", "b", "field"), ("b", "a", "field"), ("b", "c", "field")], "src string, dst string, role string")
    known = spark.createDataFrame([(x,) for x in "abc"], "entity_id string")
    got = {tuple(r.path): r.status for r in graph.inline_entities(edges, known, known.filter("entity_id = 'a'")).collect()}
    assert got == {("a",): "ok", ("a", "b"): "ok", ("a", "b", "a"): "cycle", ("a", "b", "c"): "ok"}


def test_raw_files(spark):
    rows = files.read_raw_files(spark, SF, include=["*.parquet"], exclude=["line*"]).select("relative", "length", F.sha2("content", 256).alias("x")).collect()
    expect = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(SF).glob("*.parquet") if not p.name.startswith("line")}
    assert {r.relative: r.x for r in rows} == expect and files.read_raw_files(spark, SF, include=["none"]).count() == 0
