"""JSON Schema and XSD documents as outlines.

Both become node rows with a place (``ord``), level by level: each level is written once and the next one starts from
it, until one is empty. Bullets are column expressions on node rows; markdown is one grouping by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.lineage import written
from millrace.operators.outline import ENUMS, by_levels, children_of, enum_preview, schema_constraints, schema_type

PLACE = "array<struct<rank:int,i:int,key:string>>"


def flat_line(text: Column) -> Column:
    """White space collapsed, at any length."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _place(rank: Column | int, i: Column | int = 0, key: Column | str = "") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.array(F.struct(lit(rank).cast("int").alias("rank"), lit(i).cast("int").alias("i"), lit(key).alias("key")))


def rendered(sections: DataFrame, lower: bool = True) -> DataFrame:
    """``doc_id, markdown`` from rows (doc_id, ord, depth, name, bullets array<string>, blank): one shuffle by doc_id."""
    head = F.concat(F.repeat(F.lit("#"), F.least("depth", F.lit(6))), F.lit(" "), F.col("name"))
    body = F.concat(F.array_join(F.concat(F.array(F.trim(head)), "bullets"), "\n"), F.when(F.col("blank") | (F.size("bullets") > 0), "\n").otherwise(""))
    whole = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", body.alias("md")))).alias("s"))
    text = F.concat(F.trim(F.array_join(F.transform("s", lambda x: x["md"]), "\n"), F.lit("\n ")), F.lit("\n"))
    return whole.select("doc_id", (F.lower(text) if lower else text).alias("markdown"))


def bullets(**parts: Column) -> Column:
    """``- name: text`` for all parts that have a text, in order."""
    lines = [F.concat(F.lit(f"- {name}: "), F.nullif(text, F.lit(""))) for name, text in parts.items()]
    return F.filter(F.array(*lines), lambda x: x.isNotNull())


# --- JSON Schema

# fixed values: keywords with schemas below them in the order they are shown, and how they hold them
KEYWORDS = {
    "$defs": (0, "map"), "definitions": (0, "map"), "properties": (1, "props"), "items": (2, "one or items"), "additionalProperties": (3, "one"), "patternProperties": (4, "patterns"),
    "propertyNames": (5, "one"), "contains": (6, "one"), "allOf": (7, "list"), "anyOf": (8, "list"), "oneOf": (9, "list"), "not": (10, "one"),
}


def _schema_children(level: DataFrame) -> DataFrame:
    """Nodes below schema nodes and below their containers; only objects are schemas."""
    get = lambda v, p: F.try_variant_get(v, p, "variant")
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    is_array = lambda v: F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    rows = children_of(level)
    key, value, parent = F.col("_key"), F.col("_value"), F.col("v")
    by_key = lambda j: F.create_map(*[F.lit(x) for k, e in KEYWORDS.items() for x in (k, e[j])])[key]
    how, rank = by_key(1), by_key(0)
    own_defs = is_object(get(parent, "$['$defs']"))
    fits = (
        F.when(how == "map", is_object(value) & (F.schema_of_variant(value) != "OBJECT<>") & F.when(key == "definitions", ~own_defs).otherwise(True))
        .when(how.isin("props", "patterns"), is_object(value)).when(how == "one", is_object(value)).when(how == "list", is_array(value) & get(value, "$[0]").isNotNull())
        .otherwise(is_object(value) | is_array(value))
    )
    kind = F.when(how == "one", "schema").when(how == "one or items", F.when(is_object(value), "schema").otherwise("items")).otherwise(how)
    name = F.when(how == "map", F.when(get(parent, "$['$defs']").isNotNull(), "$defs").otherwise("definitions")).otherwise(F.lower(key))
    required = F.when(how == "props", F.coalesce(F.try_variant_get(parent, "$.required", "array<string>"), F.array().cast("array<string>")))
    hidden = kind.isin("props", "items", "patterns")
    of_schema = rows.filter((F.col("kind") == "schema") & how.isNotNull() & fits)
    below = of_schema.select("doc_id", F.concat("ord", _place(rank)).alias("ord"), (F.col("depth") + F.when(hidden, 0).otherwise(1)).alias("depth"), kind.alias("kind"), name.alias("name"), required.alias("required"), F.lit(None).cast("boolean").alias("asked"), value.alias("v"))

    listed = F.col("kind").isin("items", "list")
    title = F.when(listed, F.concat("name", F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).when(F.col("kind") == "patterns", F.concat(F.lit("patternproperties: "), key)).otherwise(key)
    place = _place(0, F.when(listed, F.col("_pos")).otherwise(0), F.when(listed, "").otherwise(key))
    asked = F.when(F.col("kind") == "props", F.coalesce(F.array_contains("required", key), F.lit(False)))
    of_container = rows.filter((F.col("kind") != "schema") & is_object(value))
    return below.unionByName(of_container.select("doc_id", F.concat("ord", place).alias("ord"), (F.col("depth") + 1).alias("depth"), F.lit("schema").alias("kind"), title.alias("name"), F.lit(None).cast("array<string>").alias("required"), asked.alias("asked"), value.alias("v")))


def schema_required(v: Column, asked: Column) -> Column:
    """true or false for a property, by its parent's list; else the node's own list, sorted."""
    own = F.array_join(F.array_sort(F.try_variant_get(v, "$.required", "array<string>")), ", ")
    return F.when(asked.isNotNull(), asked.cast("string")).otherwise(own)


def schema_nodes(docs: DataFrame) -> DataFrame:
    """``doc_id, ord, depth, kind, name, asked, v`` of all nodes of JSON Schema texts; texts that are no object give none."""
    v = F.try_parse_json("text")
    text = lambda p: F.nullif(F.trim(F.try_variant_get("v", p, "string")), F.lit(""))
    root = docs.select("doc_id", v.alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    title = F.coalesce(text("$.title"), text("$['$id']"), text("$.id"), F.lit("json schema"))
    start = root.select("doc_id", F.array().cast(PLACE).alias("ord"), F.lit(1).alias("depth"), F.lit("schema").alias("kind"), title.alias("name"), F.lit(None).cast("array<string>").alias("required"), F.lit(None).cast("boolean").alias("asked"), "v")
    return by_levels(start, _schema_children).drop("required")


def json_schema_outline(docs: DataFrame, max_enums: int = ENUMS) -> DataFrame:
    """Sections ``doc_id, ord, depth, name, bullets, blank`` of JSON Schema texts, keywords in their fixed order."""
    v = F.col("v")
    values = F.transform(F.try_variant_get(v, "$.enum", "array<variant>"), lambda x: F.coalesce(flat_line(F.try_variant_get(x, "$", "string")), F.lit("none")))
    enums = F.when(F.size(values) > 0, enum_preview(values, max_enums))
    shown = bullets(description=flat_line(F.try_variant_get(v, "$.description", "string")), type=schema_type(v), constraint=schema_constraints(v), required=schema_required(v, F.col("asked")), enums=enums)
    rows = schema_nodes(docs).filter("kind IN ('schema', 'map', 'list')")
    is_schema = F.col("kind") == "schema"
    return rows.select("doc_id", "ord", "depth", "name", F.when(is_schema, shown).otherwise(F.array().cast("array<string>")).alias("bullets"), (~is_schema).alias("blank"))


# --- XSD

XSD = "http://www.w3.org/2001/XMLSchema"
XSD_NODES = "doc_id string, node int, parent int, tag string, attrs map<string,string>, qnames map<string,string>, doc string, inner string, facets array<struct<name:string,value:string>>, base string"
# fixed values: facets that are shown, attributes that constrain, and which tags are shown below which
FACETS = ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "minLength", "maxLength", "length", "pattern", "totalDigits", "fractionDigits", "whiteSpace")
OCCURS = ("minOccurs", "maxOccurs", "nillable", "default", "fixed")
USES = ("use", "default", "fixed")
_MODEL = ["sequence", "choice", "all"]
BELOW = {
    "element": ["complexType", "simpleType"], "complexType": [*_MODEL, "complexContent", "simpleContent", "attribute", "attributeGroup"], "complexContent": ["extension", "restriction"],
    "simpleContent": ["extension", "restriction"], "extension": [*_MODEL, "attribute"], "restriction": [*_MODEL, "attribute"], "simpleType": ["restriction", "list", "union"], "attribute": ["simpleType"],
} | {m: ["element", *_MODEL, "any"] for m in _MODEL}
ALWAYS_BLANK = [*_MODEL, "complexContent", "simpleContent", "extension", "attributeGroup", "any", "list", "union"]


def _xsd_rows(doc_id: str, text: str) -> Iterator[tuple]:
    """Raw rows of the XSD elements of a text in document order; names with a prefix are given with their namespace."""
    local = lambda tag: tag.rpartition("}")[2]
    parser = ElementTree.XMLPullParser(("start", "end", "start-ns", "end-ns"))
    spaces: list[tuple[str, str]] = []
    opened: list[int] = []
    scopes: dict[int, dict] = {}
    elements: list[tuple] = []
    try:
        parser.feed(text)
        parser.close()
        for event, x in parser.read_events():
            if event == "start-ns":
                spaces.append(x)
            elif event == "end-ns":
                spaces.pop()
            elif event == "start":
                scopes[id(x)] = dict(spaces)
                elements.append((x, opened[-1] if opened else -1))
                opened.append(len(elements) - 1)
            else:
                opened.pop()
    except (ElementTree.ParseError, ValueError):
        return
    if not elements or elements[0][0].tag.lower() != f"{{{XSD}}}schema".lower():
        return
    for k, (e, parent) in enumerate(elements):
        if not e.tag.startswith(f"{{{XSD}}}"):
            continue
        scope, qnames = scopes[id(e)], {}
        for a in ("type", "ref", "base"):
            if a in e.attrib:
                prefix, _, name = e.attrib[a].rpartition(":")
                if not prefix or prefix in scope:
                    qnames[a] = "{" + (scope[prefix] if prefix else "") + "}" + name
        docs = (" ".join("".join(d.itertext()).split()) for a in e.findall(f"{{{XSD}}}annotation") for d in a.findall(f"{{{XSD}}}documentation"))
        inner = next((local(c.tag) for c in e if c.tag in (f"{{{XSD}}}complexType", f"{{{XSD}}}simpleType")), None)
        rest = e if local(e.tag) == "restriction" else e.find(f"{{{XSD}}}restriction")
        facets = [] if rest is None else [{"name": local(c.tag), "value": " ".join(c.attrib["value"].split())} for c in rest if "value" in c.attrib and c.tag.startswith(f"{{{XSD}}}")]
        yield doc_id, k, parent, local(e.tag), list(e.attrib.items()), list(qnames.items()), next((d for d in docs if d), None), inner, facets, None if rest is None else rest.get("base")


def xsd_nodes(docs: DataFrame) -> DataFrame:
    """Raw node rows of XSD texts; texts that are no XSD give none."""
    text, pairs = pa.string(), pa.map_(pa.string(), pa.string())
    facets = pa.list_(pa.struct([("name", text), ("value", text)]))
    types = [("doc_id", text), ("node", pa.int32()), ("parent", pa.int32()), ("tag", text), ("attrs", pairs), ("qnames", pairs), ("doc", text), ("inner", text), ("facets", facets), ("base", text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [n for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) if t for n in _xsd_rows(d, t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(types)], [n for n, _ in types])

    xsd = docs.filter(F.contains("text", F.lit(XSD)))
    return xsd.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, XSD_NODES)


def _bare(name: Column) -> Column:
    """A name without its prefix."""
    return F.regexp_replace(name, "^[^:]*:", "")


def xsd_bullets(max_enums: int = ENUMS) -> Column:
    """Description, type, constraint, required and enums of XSD node rows."""
    tag, at = F.col("tag"), lambda k: F.col("attrs")[k]
    typed = F.coalesce(_bare(at("type")), F.concat(F.lit("ref "), _bare(at("ref"))), F.when(F.col("inner") == "complexType", "object").when(F.col("inner") == "simpleType", "string"))
    kind = (
        F.when(tag == "schema", F.concat(F.lit("schema"), F.coalesce(F.concat(F.lit(" "), at("targetNamespace")), F.lit("")))).when(tag.isin("element", "attribute"), typed).when(tag == "complexType", "object")
        .when(tag == "simpleType", F.coalesce(_bare(F.col("base")), F.lit("string"))).when(tag.isin(*_MODEL), tag).when(tag.isin("restriction", "extension"), F.coalesce(_bare(at("base")), tag))
    )
    own = [F.when(tag == "element", F.concat(F.lit(f"{k.lower()}="), flat_line(at(k)))) for k in OCCURS] + [F.when(tag == "attribute", F.concat(F.lit(f"{k}="), flat_line(at(k)))) for k in USES]
    facets = F.transform(F.filter("facets", lambda f: f["name"].isin(*FACETS)), lambda f: F.concat(f["name"], F.lit("="), f["value"]))
    constraint = F.concat_ws("; ", *own, F.concat(F.lit("base="), _bare(F.col("base"))), facets)
    least = at("minOccurs")
    required = F.when(tag == "element", F.when(least.isNull(), "true").otherwise((F.expr("try_cast(attrs['minOccurs'] AS int)") >= 1).cast("string"))).when((tag == "attribute") & at("use").isin("required", "optional", "prohibited"), (at("use") == "required").cast("string"))
    values = F.transform(F.filter("facets", lambda f: f["name"] == "enumeration"), lambda f: f["value"])
    return bullets(description=F.col("doc"), type=kind, constraint=constraint, required=required, enums=F.when(F.size(values) > 0, enum_preview(values, max_enums)))


def xsd_outline(docs: DataFrame, max_enums: int = ENUMS) -> DataFrame:
    """Sections ``doc_id, ord, depth, name, bullets, blank`` of XSD texts.

    Global elements and types come sorted by name (of equal names the last counts), particles in document order. A named
    type is expanded below all its users, but never inside itself.
    """
    nodes = written(xsd_nodes(docs).withColumn("bullets", xsd_bullets(max_enums)), "xsd")
    at = lambda k: F.col("attrs")[k]
    top = nodes.join(nodes.filter("parent = -1").select("doc_id", F.col("node").alias("parent")), ["doc_id", "parent"]).withColumn("own_name", at("name")).filter("own_name <> '' AND tag IN ('element', 'complexType', 'simpleType')")
    top = top.groupBy("doc_id", "tag", "own_name").agg(F.max_by(F.struct("node", "attrs", "bullets"), "node").alias("n")).select("doc_id", "tag", "own_name", "n.*")
    rank = F.when(F.col("tag") == "element", 0).when(F.col("tag") == "complexType", 1).otherwise(2)
    none = F.array().cast("array<string>")

    root = nodes.filter("parent = -1")
    title = F.coalesce(*[F.nullif(at(k), F.lit("")) for k in ("targetNamespace", "id", "version")], F.lit("xsd schema"))
    first = root.select("doc_id", F.array().cast(PLACE).alias("ord"), F.lit(1).alias("depth"), title.alias("name"), "bullets", F.lit(False).alias("blank"))
    heads = top.select("doc_id", rank.alias("r")).distinct().select("doc_id", _place(F.col("r")).alias("ord"), F.lit(2).alias("depth"), F.element_at(F.array(F.lit("elements"), F.lit("complextypes"), F.lit("simpletypes")), F.col("r") + 1).alias("name"), none.alias("bullets"), F.lit(True).alias("blank"))
    shown = ["doc_id", "ord", "depth", "name", "node", "tag", "type", "bullets", "inside"]
    inside = F.when(F.col("tag") == "element", none).otherwise(F.array("own_name"))
    start = top.select("doc_id", F.concat(_place(rank), _place(0, 0, F.col("own_name"))).alias("ord"), F.lit(3).alias("depth"), F.col("own_name").alias("name"), "node", "tag", _bare(at("type")).alias("type"), "bullets", inside.alias("inside"))

    allowed = F.create_map(*[x for t, below in BELOW.items() for x in (F.lit(t), F.array(*map(F.lit, below)))])
    named = F.coalesce(at("name"), at("ref"), F.col("tag"))
    heading = (
        F.when(F.col("tag") == "element", _bare(named)).when(F.col("tag") == "attribute", F.concat(F.lit("@"), _bare(named))).when(F.col("tag") == "attributeGroup", F.concat(F.lit("attributegroup: "), _bare(F.coalesce(at("ref"), at("name"), F.lit("attributegroup")))))
        .when(F.col("tag").isin("extension", "restriction") & (F.col("above") != "simpleType"), F.concat("tag", F.coalesce(F.concat(F.lit(": "), _bare(at("base"))), F.lit("")))).when(F.col("tag").isin("complexType", "simpleType"), F.lower("tag")).otherwise(F.col("tag"))
    )
    plain = F.when(F.col("tag").isin("complexContent", "simpleContent", "attributeGroup"), none).otherwise(F.col("bullets"))
    kids = nodes.select("doc_id", F.col("parent").alias("node"), F.col("node").alias("kid"), "tag", "attrs", "bullets")
    types = top.filter("tag <> 'element'").groupBy("doc_id", F.col("own_name").alias("type")).agg(F.min_by(F.struct("node", "tag", "bullets"), "tag").alias("t"))

    def below(level: DataFrame) -> DataFrame:
        over = level.select("doc_id", "ord", "depth", "node", F.col("tag").alias("above"), "inside")
        inner = over.join(kids, ["doc_id", "node"]).filter(F.array_contains(allowed[F.col("above")], F.col("tag")))
        inner = inner.select("doc_id", F.concat("ord", _place(0, F.col("kid"))).alias("ord"), (F.col("depth") + 1).alias("depth"), heading.alias("name"), F.col("kid").alias("node"), "tag", _bare(at("type")).alias("type"), plain.alias("bullets"), "inside")
        users = level.filter("tag IN ('element', 'attribute') AND type IS NOT NULL").select("doc_id", "ord", "depth", F.col("tag").alias("above"), "type", "inside")
        used = users.join(types, ["doc_id", "type"]).filter(((F.col("above") == "element") | (F.col("t.tag") == "simpleType")) & ~F.array_contains("inside", F.col("type")))
        used = used.select("doc_id", F.concat("ord", _place(1)).alias("ord"), (F.col("depth") + 1).alias("depth"), F.concat(F.lit("type: "), "type").alias("name"), F.col("t.node").alias("node"), F.col("t.tag").alias("tag"), F.lit(None).cast("string").alias("type"), F.col("t.bullets").alias("bullets"), F.concat("inside", F.array("type")).alias("inside"))
        return inner.select(*shown).unionByName(used.select(*shown))

    rows = by_levels(start.select(*shown), below)
    blank = F.col("tag").isin(*ALWAYS_BLANK, "restriction")
    return first.unionByName(heads).unionByName(rows.select("doc_id", "ord", "depth", "name", "bullets", blank.alias("blank")))

