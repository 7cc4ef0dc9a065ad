"""JSON Schema and XSD files to the entity tables: entities, fields, relations and constraints.

Schemas ask for the types of what is below them; every round answers the questions of the one before, for all files at
once, until no question is left. References are joins on (file, pointer) or (namespace, name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.lineage import discard, written
from millrace.operators.ir import resolve_names, safe_id
from millrace.operators.json_tree import schema_objects
from millrace.operators.schemas import XSD, xsd_nodes

# fixed values: primitive types, the keywords that keep a primitive from being just its type, names of unions
PRIMITIVES = ("string", "number", "integer", "boolean")
LIMITED = ("pattern", "format", "minimum", "maximum", "minLength", "maxLength", "const")
UNIONS = {"oneOf": "one_of", "anyOf": "any_of", "allOf": "all_of"}
XSD_PRIMITIVES = {
    "string": "string", "normalizedString": "string", "token": "string", "boolean": "boolean", "decimal": "number", "float": "number", "double": "number", "integer": "integer", "int": "integer", "long": "integer",
    "short": "integer", "nonNegativeInteger": "integer", "positiveInteger": "integer", "date": "string", "dateTime": "string", "time": "string", "anyURI": "string",
}
#: The pointer of an empty schema that stands in no file.
NOTHING = "-"
CONSTRAINT_COLUMNS = "kind string, values array<string>, pattern string, format string, minimum string, maximum string, min_length string, max_length string, const string"


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, what: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(what), F.lit(False))


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def _map(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def pointer_nodes(files: DataFrame) -> DataFrame:
    """``bundle, path, ptr, v, names``: all objects of JSON files by their pointer (``#/a/0/b``), objects below them being empty."""
    return schema_objects(files).select("bundle", "path", "ptr", F.try_parse_json("own").alias("v"), "names")


def ref_target(path: Column, ref: Column, mapped: Column) -> Column:
    """(path, ptr) of a reference: in the own file, in a file relative to it, or what the catalogue maps a URL to.

    Null for URLs that the catalogue lacks.
    """
    url = ref.rlike("^(https?://|urn:)")
    file, ptr = F.regexp_extract(ref, "^([^#]*)", 1), F.concat(F.lit("#"), F.regexp_extract(ref, "#(.*)$", 1))
    folder = F.regexp_extract(path, "^(.*/)?[^/]*$", 1)
    parts = F.filter(F.split(F.concat(folder, file), "/"), lambda x: ~x.isin("", "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x))))
    own = F.struct(F.when(file == "", path).otherwise(F.array_join(up, "/")).alias("path"), ptr.alias("ptr"))
    return F.when(url, F.when(mapped.isNotNull(), F.struct(mapped.alias("path"), F.lit("#").alias("ptr")))).otherwise(own)


def resolve_schema_refs(asked: DataFrame, nodes: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Rows (bundle, path, ref, ...) with ``target_path, target_ptr, target`` (the schema; null where there is none)."""
    urls = catalog if catalog is not None else asked.select("bundle", F.col("ref").alias("url"), F.col("path").alias("mapped")).limit(0)
    rows = asked.join(urls.select("bundle", F.col("url").alias("ref"), "mapped"), ["bundle", "ref"], "left").withColumn("_t", ref_target(F.col("path"), F.col("ref"), F.col("mapped")))
    rows = rows.withColumn("target_path", F.col("_t.path")).withColumn("target_ptr", F.col("_t.ptr")).drop("_t", "mapped")
    there = nodes.select("bundle", F.col("path").alias("target_path"), F.col("ptr").alias("target_ptr"), F.col("v").alias("target"))
    return rows.join(there.hint("merge"), ["bundle", "target_path", "target_ptr"], "left")


def schema_constraint_rows(rows: DataFrame, keep: list[str], entity: bool) -> DataFrame:
    """A row for each constraint of schema nodes ``v``: enum, pattern, format, range, length, const.

    An entity's enumeration comes twice, once for itself (``no`` 0) and once among the others; const counts for fields.
    """
    v, text = F.col("v"), lambda p: _get(F.col("v"), p)
    has = lambda k: _get(v, f"$.{k}", "variant").isNotNull()
    values = F.when(_is(_get(v, "$.enum", "variant"), "ARRAY"), _get(v, "$.enum", "array<string>"))
    word = lambda k: F.when(_is(_get(v, f"$.{k}", "variant"), "STRING"), text(f"$.{k}"))
    columns = [c.split(" ")[0] for c in CONSTRAINT_COLUMNS.split(", ")]
    types = dict(c.split(" ") for c in CONSTRAINT_COLUMNS.split(", "))

    def one(kind: str, when: Column, **own: Column) -> Column:
        fields = [F.lit(kind).alias("kind")] + [own.get(c, F.lit(None)).cast(types[c]).alias(c) for c in columns[1:]]
        return F.when(when, F.struct(*fields))

    found = [
        *([one("enum", values.isNotNull(), values=values)] if entity else []), one("enum", values.isNotNull(), values=values), one("pattern", word("pattern").isNotNull(), pattern=word("pattern")), one("format", word("format").isNotNull(), format=word("format")),
        one("range", has("minimum") | has("maximum"), minimum=text("$.minimum"), maximum=text("$.maximum")), one("length", has("minLength") | has("maxLength"), min_length=text("$.minLength"), max_length=text("$.maxLength")),
        *([] if entity else [one("const", has("const"), const=text("$.const"))]),
    ]
    out = rows.select(*keep, F.posexplode(F.array(*found)).alias("no", "c")).filter("c IS NOT NULL")
    return out.select(*keep, "no", "c.*")


def _kind(v: Column) -> Column:
    has = lambda k: _get(v, f"$.{k}", "variant").isNotNull()
    several = F.filter(_get(v, "$.type", "array<string>"), lambda t: t != "null")
    many = _is(_get(v, "$.type", "variant"), "ARRAY")
    t = F.when(many, F.when(F.size(several) == 1, several[0])).otherwise(_get(v, "$.type"))
    return (
        F.when(many & (F.size(several) != 1), "union").when((t == "object") | has("properties"), "object").when(t == "array", "array").when(has("oneOf") | has("anyOf") | has("allOf"), "union")
        .when(has("enum"), "enum").when(t.isin(*PRIMITIVES), t).otherwise("object")
    )


def json_schema_ir(files: DataFrame, catalog: DataFrame | None = None) -> dict[str, DataFrame]:
    """``entities, fields, relations, constraints, unresolved`` of JSON Schema files (bundle, path, text).

    Every file is asked for its root. An entity's id is its title or what its place suggests; of schemas with one id the
    first counts, by round and then by path. Bare primitives are types, not entities; what can't be resolved is ``any``.
    Fields come in the order of their file. Questions travel as pointers; each round looks up the objects they ask for.
    All sides grow with the files: without the hint Spark would broadcast some, by what few columns of a stored table seem to hold.
    """
    nodes = written(pointer_nodes(files), "pointers").hint("merge")
    who, spot = ["bundle", "owner", "role", "pos"], ["bundle", "path", "ptr"]
    no_path = F.array().cast("array<string>").alias("via")
    asks = nodes.filter("ptr = '#'").select("bundle", F.lit("").alias("owner"), F.lit("root").alias("role"), F.lit(0).alias("pos"), "path", "ptr", safe_id(_stem(F.col("path"))).alias("suggested"), no_path)
    asks = written(asks, "asks")
    answers, found, fields, unresolved = [], [], [], []
    known = nodes.select("bundle", F.lit("").alias("entity_id")).limit(0)
    while asks.limit(1).count():
        v = F.col("v")
        ref = _get(v, "$['$ref']")
        # an array without items has elements of an empty schema; what is no object isn't among the nodes
        asked = asks.join(nodes, spot, "left").withColumn("v", F.when(F.col("ptr") == NOTHING, F.parse_json(F.lit("{}"))).otherwise(v))
        asked = written(asked, "asked")
        pointing = resolve_schema_refs(asked.filter(ref.isNotNull()).withColumn("ref", ref).drop("v", "names"), nodes.drop("names"), catalog)
        hop = F.concat_ws("", "target_path", "target_ptr")
        pointing = written(pointing.withColumn("lost", F.col("target").isNull() | F.array_contains("via", hop)).drop("target"), "refs")
        again = pointing.filter("NOT lost").select(*who, F.col("target_path").alias("path"), F.col("target_ptr").alias("ptr"), safe_id(F.concat(_stem(F.col("target_path")), "target_ptr")).alias("suggested"), F.concat("via", F.array(hop)).alias("via"))
        unresolved.append(pointing.filter("lost").select(*who, "path", "ref"))
        answers.append(pointing.filter("lost").select(*who, F.lit("any").alias("type"), F.lit(False).alias("is_ref")))

        plain = asked.filter(ref.isNull())
        answers.append(plain.filter(~_is(v, "OBJECT")).select(*who, F.lit("any").alias("type"), F.lit(False).alias("is_ref")))
        named = F.coalesce(F.nullif(F.trim(_get(v, "$.title")), F.lit("")), F.col("suggested"))
        bare = _get(v, "$.type").isin(*PRIMITIVES) & _get(v, "$.properties", "variant").isNull() & _get(v, "$.enum", "variant").isNull()
        for k in LIMITED:
            bare = bare & _get(v, f"$.{k}", "variant").isNull()
        objects = plain.filter(_is(v, "OBJECT")).withColumn("entity_id", safe_id(named)).withColumn("bare", F.coalesce(bare, F.lit(False)))
        answers.append(objects.select(*who, F.when(F.col("bare"), _get(v, "$.type")).otherwise(F.col("entity_id")).alias("type"), (~F.col("bare")).alias("is_ref")))

        first = F.row_number().over(Window.partitionBy("bundle", "entity_id").orderBy("path", "owner", "role", "pos"))
        new = objects.filter("NOT bare").withColumn("_n", first).filter("_n = 1").join(known.hint("merge"), ["bundle", "entity_id"], "left_anti")
        enum = _is(_get(v, "$.enum", "variant"), "ARRAY")
        union = F.coalesce(*[F.when(_is(_get(v, f"$.{k}", "variant"), "ARRAY"), k) for k in UNIONS])
        base = F.when(enum, "enum").otherwise(_kind(v))
        new = written(new.select("bundle", "entity_id", "path", "ptr", base.alias("base"), union.alias("union"), "v", "names"), "entities")
        found.append(new.select("bundle", "entity_id", "path", "base", "union", "v"))
        earlier, known = known, written(known.unionByName(new.select("bundle", "entity_id")), "known")
        discard(earlier)

        required = F.coalesce(F.array_contains(_get(v, "$.required", "array<string>"), F.col("name")), F.lit(False))
        props = new.filter("base = 'object'").select("bundle", "entity_id", "path", "ptr", "v", F.posexplode("names").alias("pos", "name"))
        step = F.replace(F.replace("name", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        props = props.select("bundle", "entity_id", "path", "pos", "name", required.alias("required"), F.concat("ptr", F.lit("/properties/"), step).alias("ptr"))
        props = written(props.join(nodes.drop("names"), spot, "left"), "fields")
        fields.append(props.select("bundle", "entity_id", "path", "pos", "name", "required", "v"))
        options = F.coalesce(*[F.when(F.col("union") == k, F.size(_get(v, f"$.{k}", "array<variant>"))) for k in UNIONS])
        options = new.filter("union IS NOT NULL").withColumn("n", options).filter("n > 0").select("bundle", "entity_id", "path", "ptr", "union", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
        items = new.filter("base = 'array'").withColumn("at", F.when(_get(v, "$.items", "variant").isNull(), NOTHING).otherwise(F.concat("ptr", F.lit("/items"))))
        below = props.select("bundle", F.col("entity_id").alias("owner"), F.lit("field").alias("role"), "pos", "path", "ptr", F.concat("entity_id", F.lit("."), "name").alias("suggested"), no_path)
        below = below.unionByName(items.select("bundle", F.col("entity_id").alias("owner"), F.lit("element").alias("role"), F.lit(0).alias("pos"), "path", F.col("at").alias("ptr"), F.concat("entity_id", F.lit(".items")).alias("suggested"), no_path))
        below = below.unionByName(options.select("bundle", F.col("entity_id").alias("owner"), F.lit("choice").alias("role"), "pos", "path", F.concat("ptr", F.lit("/"), "union", F.lit("/"), F.col("pos").cast("string")).alias("ptr"), F.concat("entity_id", F.lit("."), "union", F.lit("."), F.col("pos").cast("string")).alias("suggested"), no_path))
        asks = written(below.unionByName(again), "asks")

    def union_all(tables: list[DataFrame], empty: DataFrame) -> DataFrame:
        out = empty
        for t in tables:
            out = out.unionByName(t)
        return out

    no = asks.limit(0)
    typed = union_all(answers, no.select(*who, F.lit("any").alias("type"), F.lit(False).alias("is_ref")))
    no_v = no.withColumn("v", F.parse_json(F.lit("{}")))
    every = union_all(found, no_v.select("bundle", F.col("owner").alias("entity_id"), "path", F.lit("").alias("base"), F.lit("").alias("union"), "v"))
    v, key = F.col("v"), ["bundle", "entity_id"]
    kind = F.when(F.col("union").isNotNull(), "union").otherwise(F.col("base"))
    entities = every.select(*key, kind.alias("kind"), _get(v, "$.title").alias("name"), _get(v, "$.description").alias("description"), F.col("path").alias("source_file"), _map(UNIONS, F.col("union")).alias("choice"))
    rows = union_all(fields, no_v.select("bundle", F.col("owner").alias("entity_id"), "path", "pos", F.lit("").alias("name"), F.lit(False).alias("required"), "v"))
    of_field = typed.filter("role = 'field'").select("bundle", F.col("owner").alias("entity_id"), "pos", "type", "is_ref")
    ref = _get(v, "$['$ref']")
    place = F.concat("path", F.lit(" :: "), F.coalesce(F.concat(F.lit("$ref="), ref), F.concat(F.lit("properties."), "name")))
    out_fields = rows.join(of_field.hint("merge"), [*key, "pos"], "left").select(
        *key, "pos", "name", F.when(F.col("is_ref"), None).otherwise(F.coalesce("type", F.lit("any"))).alias("type_prim"), F.when(F.col("is_ref"), F.col("type")).alias("type_ref"), _get(v, "$.description").alias("description"), "required",
        F.col("required").cast("int").alias("card_min"), F.when(_get(v, "$.type").eqNullSafe(F.lit("array")), None).otherwise(F.lit(1)).alias("card_max"), _get(v, "$.default").alias("default"), _get(v, "$.examples", "array<string>").alias("examples"), place.alias("locator"),
    )
    relations = typed.filter("role IN ('element', 'choice')").select("bundle", F.col("owner").alias("entity_id"), "pos", "role", F.col("type").alias("target"), "is_ref")
    keep = [*key, "field_name", "pos", "target"]
    of_entities = schema_constraint_rows(every.select(*key, F.lit(None).cast("string").alias("field_name"), F.lit(0).alias("pos"), F.col("entity_id").alias("target"), "v"), keep, True)
    of_entities = of_entities.withColumn("target", F.when(F.col("no") > 0, F.col("target")))
    of_fields = schema_constraint_rows(rows.select(*key, F.col("name").alias("field_name"), "pos", F.concat("entity_id", F.lit("."), "name").alias("target"), "v"), keep, False)
    lost = union_all(unresolved, no.select(*who, "path", F.lit("").alias("ref")))
    return {"entities": entities, "fields": out_fields, "relations": relations, "constraints": of_entities.unionByName(of_fields), "unresolved": lost}


# --- XSD

def _qid(source: Column, ns: Column, name: Column) -> Column:
    return safe_id(F.concat(source, F.lit(":"), F.when(ns != "", F.concat(ns, F.lit("#"))).otherwise(""), name))


def xsd_ir(files: DataFrame) -> dict[str, DataFrame]:
    """``entities, fields, relations, constraints`` of XSD files (bundle, path, text, source_id).

    Entities are global simple and complex types, global elements with a type of their own, and the types inside their
    elements, round by round. Of equal names in a bundle the last file's counts.
    """
    meta = files.select("bundle", "path", "source_id", F.to_json(F.struct("bundle", "path")).alias("doc_id"), "text")
    raw = xsd_nodes(meta).join(meta.drop("text"), "doc_id")
    space = raw.filter("parent = -1").select("doc_id", F.coalesce(F.col("attrs")["targetNamespace"], F.lit("")).alias("tns"))
    nodes = written(raw.join(space, "doc_id"), "xsd")
    at = lambda k: F.col("attrs")[k]
    key = ["bundle", "entity_id"]
    root = nodes.filter("parent = -1").select("doc_id", F.col("node").alias("parent"))
    top = nodes.join(root, ["doc_id", "parent"]).filter(F.col("tag").isin("complexType", "simpleType", "element") & (at("name") != "")).withColumn("local", at("name"))
    last = F.row_number().over(Window.partitionBy("bundle", "tns", "local", "tag").orderBy(F.desc("path"), F.desc("node")))
    top = written(top.withColumn("_n", last).filter("_n = 1").withColumn("entity_id", _qid(F.col("source_id"), F.col("tns"), F.col("local"))), "symbols")
    rank = F.when(F.col("tag") == "complexType", 1).when(F.col("tag") == "simpleType", 2).otherwise(3)
    symbols = top.select("bundle", F.col("tns").alias("ns"), "local", rank.alias("rank"), "entity_id")

    def typed(rows: DataFrame, qname: Column, written_as: Column) -> DataFrame:
        """Adds ``prim, ref``: by namespace and name, else by the name of a primitive, else a string."""
        rows = rows.withColumn("ns", F.regexp_extract(qname, r"^\{([^}]*)\}", 1)).withColumn("local", F.regexp_extract(qname, r"\}(.*)$", 1))
        of_xsd = F.when(F.col("ns") == XSD, _map(XSD_PRIMITIVES, F.col("local")))
        out = resolve_names(rows, symbols).withColumnRenamed("entity_id", "hit")
        ref = F.when(of_xsd.isNull(), F.col("hit"))
        by_name = _map(XSD_PRIMITIVES, F.element_at(F.split(F.coalesce(written_as, F.lit("")), ":"), -1))
        return out.withColumn("ref", ref).withColumn("prim", F.when(ref.isNull(), F.coalesce(of_xsd, by_name, F.lit("string")))).drop("ns", "local", "hit")

    facets = lambda name: F.transform(F.filter("facets", lambda f: f["name"] == name), lambda f: f["value"])

    def simple(rows: DataFrame) -> DataFrame:
        return rows.select(*key, F.when(F.size(facets("enumeration")) > 0, "enum").otherwise("string").alias("kind"), F.lit(None).cast("string").alias("name"), "path", facets("enumeration").alias("values"), F.get(facets("pattern"), F.lit(0)).alias("pattern"))

    def complex_(rows: DataFrame, name: Column) -> DataFrame:
        return rows.select(*key, F.lit("object").alias("kind"), name.alias("name"), "path", F.lit(None).cast("array<string>").alias("values"), F.lit(None).cast("string").alias("pattern"))

    kid = nodes.select("doc_id", F.col("parent").alias("at"), F.col("node").alias("kid"), F.col("tag").alias("kid_tag"), F.col("attrs").alias("kid_attrs"), F.col("qnames").alias("kid_qnames"), F.col("facets").alias("kid_facets"))
    inline = kid.filter("kid_tag IN ('complexType', 'simpleType')")
    inline = inline.groupBy("doc_id", "at").agg(F.min_by(F.struct("kid", "kid_tag", "kid_facets"), F.when(F.col("kid_tag") == "simpleType", 0).otherwise(1)).alias("own"))
    globals_ = top.filter("tag = 'element'").join(inline.withColumnRenamed("at", "node"), ["doc_id", "node"], "left")
    with_own = globals_.filter("own IS NOT NULL").join(top.filter("tag <> 'element'").select(*key), key, "left_anti")
    complex_types = top.filter("tag = 'complexType'")
    entities = [
        simple(top.filter("tag = 'simpleType'").join(complex_types.select(*key), key, "left_anti")), complex_(complex_types, F.col("local")),
        simple(with_own.filter("own.kid_tag = 'simpleType'").withColumn("facets", F.col("own.kid_facets"))), complex_(with_own.filter("own.kid_tag = 'complexType'"), F.col("local")),
    ]
    place = ["bundle", "doc_id", "path", "source_id", "tns"]
    owners = complex_types.select(*place, "entity_id", "node").unionByName(with_own.filter("own.kid_tag = 'complexType'").select(*place, "entity_id", F.col("own.kid").alias("node")))
    held = kid.filter("kid_tag IN ('complexContent', 'simpleContent')").select("doc_id", F.col("at").alias("node"), F.col("kid").alias("_c"))
    bases = kid.filter("kid_tag = 'extension'").select("doc_id", F.col("at").alias("_c"), F.col("kid_qnames")["base"].alias("qname"), F.col("kid_attrs")["base"].alias("base"))
    extended = complex_types.select(*place, "entity_id", "node").join(held, ["doc_id", "node"]).join(bases, ["doc_id", "_c"]).filter("base <> ''").withColumnRenamed("entity_id", "owner")
    extended = typed(extended, F.col("qname"), F.col("base"))
    relations = extended.select("bundle", F.col("owner").alias("entity_id"), F.lit(0).alias("pos"), F.lit("extends").alias("role"), F.coalesce("ref", "base").alias("target"), F.col("ref").isNotNull().alias("is_ref"))

    elements = globals_.select("bundle", F.col("tns").alias("ns"), F.col("local").alias("name_"), at("type").alias("g_type"), F.col("qnames")["type"].alias("g_qname"), F.col("doc_id").alias("g_doc"), "own")
    fields, known = [], top.select(*key).distinct()
    owners = written(owners, "owners")
    while owners.limit(1).count():
        model = kid.filter("kid_tag IN ('sequence', 'all', 'choice')").select("doc_id", F.col("at").alias("node"), "kid", F.when(F.col("kid_tag") == "sequence", 0).when(F.col("kid_tag") == "all", 1).otherwise(2).alias("r"))
        content = owners.join(model, ["doc_id", "node"]).groupBy(*place, "entity_id").agg(F.min_by("kid", F.struct("r", "kid")).alias("at"))
        rows = content.join(kid.filter("kid_tag = 'element'"), ["doc_id", "at"]).filter(F.col("kid_attrs")["name"].isNotNull() | F.col("kid_attrs")["ref"].isNotNull())
        a = F.col("kid_attrs")
        rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("bundle", "entity_id").orderBy("kid"))).withColumn("name", F.coalesce(a["name"], F.element_at(F.split(a["ref"], ":"), -1)))
        rows = rows.join(inline.select("doc_id", F.col("at").alias("kid"), "own"), ["doc_id", "kid"], "left")
        pointing = a["type"].isNull() & F.col("own").isNull()
        qname = F.when(pointing, F.col("kid_qnames")["ref"])
        rows = rows.withColumn("r_ns", F.regexp_extract(qname, r"^\{([^}]*)\}", 1)).withColumn("r_local", F.regexp_extract(qname, r"\}(.*)$", 1))
        seen = elements.select("bundle", F.col("ns").alias("r_ns"), F.col("name_").alias("r_local"), "g_type", "g_qname", "g_doc", F.col("own").alias("g_own"))
        rows = rows.join(seen, ["bundle", "r_ns", "r_local"], "left")
        rows = rows.withColumn("own_doc", F.when(F.col("own").isNotNull(), F.col("doc_id")).otherwise(F.col("g_doc"))).withColumn("own", F.coalesce("own", "g_own"))
        rows = rows.withColumn("qname", F.coalesce(F.col("kid_qnames")["type"], "g_qname")).withColumn("type", F.coalesce(a["type"], "g_type"))
        rows = rows.withColumn("inner", F.when(F.col("own").isNotNull(), _qid(F.col("source_id"), F.col("tns"), F.concat("entity_id", F.lit("."), "name"))))
        rows = written(typed(rows.withColumnRenamed("entity_id", "owner"), F.col("qname"), F.col("type")), "fields")
        fields.append(rows)
        fresh = rows.filter("inner IS NOT NULL").withColumn("entity_id", F.col("inner")).dropDuplicates(key).join(known, key, "left_anti")
        fresh = written(fresh.select(*place, "entity_id", "own", "own_doc"), "inner")
        known = written(known.unionByName(fresh.select(*key)), "known")
        entities += [simple(fresh.filter("own.kid_tag = 'simpleType'").withColumn("facets", F.col("own.kid_facets"))), complex_(fresh.filter("own.kid_tag = 'complexType'"), F.col("entity_id"))]
        owners = written(fresh.filter("own.kid_tag = 'complexType'").select("bundle", F.col("own_doc").alias("doc_id"), "path", "source_id", "tns", "entity_id", F.col("own.kid").alias("node")), "owners")

    every = entities[0]
    for e in entities[1:]:
        every = every.unionByName(e)
    every = written(every, "entities")
    a = F.col("kid_attrs")
    least, most = F.coalesce(a["minOccurs"], F.lit("1")).cast("int"), F.coalesce(a["maxOccurs"], F.lit("1"))
    shape = lambda r: r.select("bundle", F.col("owner").alias("entity_id"), "pos", "name", F.when(F.col("inner").isNull(), F.col("prim")).alias("type_prim"), F.coalesce("inner", "ref").alias("type_ref"), F.lit(None).cast("string").alias("description"), (least >= 1).alias("required"), least.alias("card_min"), F.when(most != "unbounded", most.cast("int")).alias("card_max"), F.concat(F.lit("xsd:field:"), "owner", F.lit("."), "name").alias("locator"))
    out = shape(fields[0]) if fields else every.select("bundle", "entity_id", F.lit(0).alias("pos"), "name", F.lit("").alias("type_prim"), F.lit("").alias("type_ref"), "name", F.lit(True).alias("required"), F.lit(0).alias("card_min"), F.lit(0).alias("card_max"), F.lit("").alias("locator")).limit(0)
    for f in fields[1:]:
        out = out.unionByName(shape(f))
    limits = every.select(*key, F.explode(F.array(F.when(F.size("values") > 0, "enum"), F.when(F.col("pattern") != "", "pattern"))).alias("kind"), "values", "pattern").filter("kind IS NOT NULL")
    limits = limits.select(*key, F.lit(None).cast("string").alias("field_name"), F.lit(0).alias("pos"), "kind", F.when(F.col("kind") == "enum", F.col("values")).alias("values"), F.when(F.col("kind") == "pattern", F.col("pattern")).alias("pattern"))
    shown = every.select(*key, "kind", "name", F.lit(None).cast("string").alias("description"), F.col("path").alias("source_file"))
    return {"entities": shown, "fields": out, "relations": relations, "constraints": limits}
