"""Retrieval documents from the entity tables: headers, packed fields, constraints, relationships, facts, glossary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.lineage import written
from millrace.operators.glossary import glossary_docs
from millrace.operators.graph import of_few
from millrace.operators.ir import KEYS, cardinality_text, display_name, entity_edges, entity_refs, safe_id, type_text

# fixed values: limits of a document
MAX_FIELDS, MAX_CHARS, INLINE_LINES, ENUM_VALUES = 30, 8000, 1200, 20


def _lines(*parts: Column) -> Column:
    return F.concat(F.concat_ws("\n", *parts), F.lit("\n"))


def _described(description: Column) -> Column:
    text = F.trim(description)
    return F.when(text != "", text)


def _or_empty(df: DataFrame, column: str) -> Column:
    """A text column, empty where the table lacks it or holds null."""
    return F.coalesce(F.col(column), F.lit("")) if column in df.columns else F.lit("")


def bundle_line(entities: DataFrame) -> Column:
    return F.concat(F.lit("Bundle: "), "bundle", F.lit(" | Source: "), _or_empty(entities, "source_id"), F.lit(" "), _or_empty(entities, "version"), F.lit(" | Kind: "), "kind")


def entity_header_docs(entities: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One header document per entity. ``keep``, here and below: columns of entities that stay beside their documents."""
    name = display_name(F.col("name"), F.col("entity_id"))
    files = F.when(F.trim("source_file") != "", F.concat(F.lit("Source files: "), F.trim("source_file")))
    text = _lines(
        F.concat(F.lit("# Entity: "), name), F.concat(F.lit("EntityId: "), "entity_id"), bundle_line(entities), files,
        F.concat(F.lit("\nDescription:\n"), _described(F.col("description"))),
    )
    return entities.select(*KEYS, F.lit("entity_header").alias("type"), F.lit(1).alias("part"), text.alias("text"), *keep)


def field_line(name: Column, prim: Column, ref: Column, low: Column, high: Column, required: Column) -> Column:
    need = F.when(required, " required").otherwise("")
    return F.rtrim(F.concat(F.lit("- "), name, F.lit(" : "), type_text(prim, ref), F.lit(" "), cardinality_text(low, high), need))


def constraint_kinds(constraints: DataFrame) -> DataFrame:
    """``bundle, entity_id, pos, kinds``: distinct kinds of each field's constraints, sorted."""
    return constraints.groupBy(*KEYS, "pos").agg(F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"))


def with_kinds(fields: DataFrame, constraints: DataFrame | None) -> DataFrame:
    """Adds ``kinds`` of each field's constraints, if that isn't done yet."""
    return fields if constraints is None or "kinds" in fields.columns else fields.join(constraint_kinds(constraints), [*KEYS, "pos"], "left")


def _shown(entities: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return entities.select(*KEYS, display_name(F.col("name"), F.col("entity_id")).alias("shown"), *keep)


def with_field_lines(fields: DataFrame, constraints: DataFrame | None = None) -> DataFrame:
    """Adds ``line`` and ``block`` (the line and its details: description, kinds of constraints, first two examples)."""
    line = field_line(*[F.col(c) for c in ("name", "type_prim", "type_ref", "card_min", "card_max", "required")])
    details = [F.concat(F.lit("  - description: "), _described(F.col("description")))]
    fields = with_kinds(fields, constraints)
    if "kinds" in fields.columns:
        details.append(F.concat(F.lit("  - constraints: "), "kinds"))
    if "examples" in fields.columns:
        shown = F.array_join(F.transform(F.slice("examples", 1, 2), lambda x: F.to_json(F.struct(x.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(x.alias("x")))) - 6)), ", ")
        details.append(F.when(F.size("examples") > 0, F.concat(F.lit("  - examples: ["), shown, F.lit("]"))))
    return fields.withColumn("line", line).withColumn("block", F.concat_ws("\n", "line", *details))


def _folded(fields: DataFrame, max_fields: int, max_chars: int, constraints: DataFrame | None) -> DataFrame:
    """``bundle, entity_id, f`` (ordered fields), ``p`` (the part of each)."""
    rows = with_field_lines(fields, constraints).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("pos", "name", F.length("line").alias("n"), "block"))).alias("f"))
    zero = F.struct(F.lit(1).alias("part"), F.lit(0).alias("count"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("parts"))

    def step(acc: Column, f: Column) -> Column:
        count, chars = acc["count"] + 1, acc["chars"] + f["n"] + 1
        full = (count >= max_fields) | (chars >= max_chars)
        return F.struct((acc["part"] + full.cast("int")).alias("part"), F.when(full, 0).otherwise(count).alias("count"), F.when(full, 0).otherwise(chars).alias("chars"), F.concat(acc["parts"], F.array(acc["part"])).alias("parts"))

    return rows.withColumn("p", F.aggregate("f", zero, step, lambda a: a["parts"]))


def pack_fields(fields: DataFrame, max_fields: int = MAX_FIELDS, max_chars: int = MAX_CHARS, constraints: DataFrame | None = None) -> DataFrame:
    """Consecutive fields in chunks: ``bundle, entity_id, pos, name, block, part, parts``.

    A chunk closes after the field that fills it, by count or by the length of the lines; only lengths enter the fold.
    """
    out = _folded(fields, max_fields, max_chars, constraints).select(*KEYS, F.array_max("p").alias("parts"), F.explode_outer(F.arrays_zip("f", "p")).alias("z"))
    return out.select(*KEYS, F.col("z.f.pos").alias("pos"), F.col("z.f.name").alias("name"), F.col("z.f.block").alias("block"), F.col("z.p").alias("part"), "parts")


def entity_fields_docs(fields: DataFrame, entities: DataFrame, max_fields: int = MAX_FIELDS, max_chars: int = MAX_CHARS, constraints: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Packed field documents, numbered i/total, with the ``paths`` (Entity.field) they hold; one shuffle by entity."""
    folded = _folded(fields, max_fields, max_chars, constraints).withColumn("parts", F.array_max("p"))
    rows = folded.select(*KEYS, "f", "p", "parts", F.explode_outer(F.sequence(F.lit(1), F.col("parts"))).alias("part"))
    own = F.filter(F.arrays_zip("f", "p"), lambda z: z["p"] == F.col("part"))
    named = rows.withColumn("b", own).join(_shown(entities, keep), KEYS)
    head = F.concat(F.lit("## Fields for "), "shown", F.lit(" ("), F.col("part").cast("string"), F.lit("/"), F.col("parts").cast("string"), F.lit(")"))
    text = _lines(head, F.array_join(F.transform("b", lambda z: z["f"]["block"]), "\n"))
    paths = F.transform("b", lambda z: F.concat("shown", F.lit("."), z["f"]["name"]))
    return named.select(*KEYS, F.lit("entity_fields").alias("type"), "part", text.alias("text"), "parts", paths.alias("paths"), *keep)


# fixed values: what a constraint line shows of its columns, in order
_CONSTRAINT_PARTS = ("values", "pattern", "minimum,maximum", "min_length,max_length", "format", "const", "message")
_CONSTRAINT_NAMES = {"minimum,maximum": "range", "min_length,max_length": "length"}


def constraint_line(constraints: DataFrame, shown: Column) -> Column:
    """``- kind=... target=...`` and whatever columns the table has; a field's constraint names Entity.field by default."""
    has = lambda c: c in constraints.columns
    default = F.when(F.col("field_name").isNotNull(), F.concat(shown, F.lit("."), "field_name"))
    target = F.coalesce(F.nullif(F.trim("target"), F.lit("")), default) if has("target") else default
    parts = [F.concat(F.lit("  - kind="), F.coalesce("kind", F.lit("constraint"))), F.concat(F.lit("target="), target)]
    for name in _CONSTRAINT_PARTS:
        columns = name.split(",")
        if not all(map(has, columns)):
            continue
        label = F.lit(_CONSTRAINT_NAMES.get(name, name) + "=")
        if name == "values":
            quoted = F.array_join(F.transform(F.slice("values", 1, ENUM_VALUES), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
            parts.append(F.concat(label, F.lit("["), quoted, F.lit("]"), F.when(F.size("values") > ENUM_VALUES, "...").otherwise("")))
        elif len(columns) == 2:
            low, high = (F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns)
            parts.append(F.when(F.col(columns[0]).isNotNull() | F.col(columns[1]).isNotNull(), F.concat(label, F.lit("["), low, F.lit(","), high, F.lit("]"))))
        else:
            parts.append(F.concat(label, F.col(name).cast("string")))
    return F.concat_ws(" ", *parts)


def entity_constraints_docs(constraints: DataFrame, entities: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Constraints of an entity (``pos`` 0, no ``field_name``), then of its fields, as lines; none without constraints."""
    named = constraints.join(_shown(entities, keep), KEYS)
    line = constraint_line(constraints, F.col("shown"))
    order = F.struct("pos", *(["no"] if "no" in constraints.columns else []), line.alias("line"))
    whole = named.groupBy(*KEYS, "shown").agg(F.array_sort(F.collect_list(order)).alias("c"), *[F.first(k).alias(k) for k in keep])
    return whole.select(*KEYS, F.lit("entity_constraints").alias("type"), F.lit(1).alias("part"), _lines(F.concat(F.lit("## Constraints for "), "shown"), F.array_join(F.transform("c", lambda x: x["line"]), "\n")).alias("text"), *keep)


def entity_relationships_docs(entities: DataFrame, fields: DataFrame, relations: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """What an entity extends, all its references (``refs``, if entities have them already), and its source files."""
    rows = entities if "refs" in entities.columns else entities.join(entity_refs(entity_edges(fields, relations)), KEYS, "left")
    extends = F.lit(None).cast("string")
    if relations is not None:
        bases = relations.filter("role = 'extends'").groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("pos", "target"))).alias("bases"))
        rows = rows.join(bases, KEYS, "left")
        extends = F.concat(F.lit("Extends:\n"), F.array_join(F.transform("bases", lambda x: F.concat(F.lit("- ref:"), x["target"])), "\n"))
    listed = F.concat(F.lit("References:\n"), F.array_join(F.transform("refs", lambda r: F.concat(F.lit("- "), r)), "\n"))
    files = F.when(F.trim("source_file") != "", F.concat(F.lit("Provenance files:\n- "), F.trim("source_file")))
    text = _lines(F.concat(F.lit("## Relationships for "), display_name(F.col("name"), F.col("entity_id"))), extends, listed, files)
    return rows.select(*KEYS, F.lit("entity_relationships").alias("type"), F.lit(1).alias("part"), text.alias("text"), *keep)


def field_fact_docs(fields: DataFrame, entities: DataFrame, constraints: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One small document per field; a ``locator`` column gives its provenance line."""
    rows = with_kinds(fields.filter(F.trim("name") != "").join(_shown(entities, keep), KEYS), constraints)
    text = _lines(
        F.concat(F.lit("# Field: "), "shown", F.lit("."), "name"), F.rtrim(F.concat(F.lit("Type: "), type_text(F.col("type_prim"), F.col("type_ref")), F.lit(" "), cardinality_text(F.col("card_min"), F.col("card_max")))),
        F.concat(F.lit("Description: "), _described(F.col("description"))), F.concat(F.lit("Constraints: "), "kinds"), *([F.concat(F.lit("Provenance: "), "locator")] if "locator" in fields.columns else []),
    )
    return rows.select(*KEYS, F.lit("field_fact").alias("type"), F.col("pos").alias("part"), text.alias("text"), "name", F.concat("shown", F.lit("."), "name").alias("path"), *keep)


def entity_inline_docs(inlined: DataFrame, entities: DataFrame, fields: DataFrame, most: int = INLINE_LINES) -> DataFrame:
    """``root, text``: the expanded tree of each root as an outline of at most ``most`` lines.

    ``inlined`` comes from edges with the ``pos`` of their field. An expanded entity shows its name and kind, then each
    field with type and cardinality; a field that is expanded shows ``any`` and its entity below, one that is not its
    reference. Only the rows of one root meet in a task, and of them at most the lines that are shown.
    """
    nodes = inlined.filter("role IN ('root', 'field')")
    shown = entities.select("entity_id", display_name(F.col("name"), F.col("entity_id")).alias("shown"), "kind")
    # the order of lines: a node's header after the line of its field, fields by position
    order = F.flatten(F.transform("places", lambda p: F.array(p, F.lit(1))))
    ok = nodes.filter("status = 'ok'").select("root", "entity_id", "depth", order.alias("ord"))
    shown, fields = of_few(shown, "entity_id", ok.select("entity_id")), of_few(fields, "entity_id", ok.select("entity_id"))
    indent = F.repeat(F.lit("    "), F.col("depth"))
    heads = ok.join(shown, "entity_id").select("root", "ord", F.concat(indent, F.lit("- "), "shown", F.lit(" ("), "kind", F.lit(")")).alias("line"))
    grown = nodes.filter("status = 'ok' AND depth > 0").select(F.col("root").alias("_root"), order.alias("_ord"))
    own = ok.join(fields.select("entity_id", "pos", "name", "type_prim", "type_ref", "card_min", "card_max"), "entity_id")
    own = own.withColumn("below", F.concat("ord", F.array(F.col("pos").cast("int"), F.lit(1))))
    own = own.join(grown, (F.col("root") == F.col("_root")) & (F.col("below") == F.col("_ord")), "left")
    kind = F.when(F.col("_root").isNotNull(), "any").otherwise(type_text(F.col("type_prim"), F.col("type_ref")))
    line = F.rtrim(F.concat(indent, F.lit("  * "), "name", F.lit(": "), kind, F.lit(" "), cardinality_text(F.col("card_min"), F.col("card_max"))))
    lines = heads.unionByName(own.select("root", F.concat("ord", F.array(F.col("pos").cast("int"), F.lit(0))).alias("ord"), line.alias("line")))
    first = lines.withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy("ord"))).filter(F.col("r") <= most)
    return first.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("r", "line"))).alias("l")).select("root", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def inline_docs(inlined: DataFrame, entities: DataFrame, fields: DataFrame, most: int = INLINE_LINES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents of expanded roots, with the heading of their entity."""
    trees = entity_inline_docs(inlined, entities, fields, most).withColumnRenamed("text", "tree")
    rows = entities.join(trees, F.col("entity_id") == F.col("root"))
    text = _lines(F.concat(F.lit("# Inlined schema: "), display_name(F.col("name"), F.col("entity_id"))), F.concat(F.lit("EntityId: "), "entity_id"), bundle_line(entities), F.lit(""), F.col("tree"))
    return rows.select(*KEYS, F.lit("entity_inline").alias("type"), F.lit(1).alias("part"), text.alias("text"), *keep)


def build_docs(entities: DataFrame, fields: DataFrame, constraints: DataFrame, relations: DataFrame | None = None, inlined: DataFrame | None = None) -> DataFrame:
    """All document types in one table: ``doc_id, bundle, entity_id, type, part, text, metadata``.

    ``doc_id`` is bundle, type, entity and part joined by ``::``. Characters that are replaced in an entity's id are made
    up for by a short digest, so two entities never share a doc_id. ``metadata`` (a map) has the entity's name, kind,
    references and source, and what the type adds: chunk number and total, paths, the field.
    """
    # what all documents of an entity say of it is attached once, before there are texts; so are the kinds of constraints
    base = F.create_map(F.lit("entity_name"), display_name(F.col("name"), F.col("entity_id")), F.lit("kind"), F.col("kind"), F.lit("refs"), F.coalesce(F.array_join("refs", ","), F.lit("")), F.lit("source_files"), F.coalesce(F.trim("source_file"), F.lit("")))
    entities = written(entities.join(entity_refs(entity_edges(fields, relations)), KEYS, "left").withColumn("base", base), "entities")
    fields, keep = written(with_kinds(fields, constraints), "fields"), ("base",)
    none = F.create_map().cast("map<string,string>")
    chunk = F.create_map(F.lit("chunk_index"), F.col("part").cast("string"), F.lit("chunk_total"), F.col("parts").cast("string"), F.lit("paths"), F.array_join("paths", ","))
    parts = [
        entity_header_docs(entities, keep).withColumn("own", none), entity_fields_docs(fields, entities, constraints=constraints, keep=keep).withColumn("own", chunk),
        entity_constraints_docs(constraints, entities, keep).withColumn("own", none), entity_relationships_docs(entities, fields, relations, keep).withColumn("own", none),
        field_fact_docs(fields, entities, constraints, keep).withColumn("own", F.create_map(F.lit("field"), "name", F.lit("path"), "path")),
    ]
    if inlined is not None:
        parts.append(inline_docs(inlined, entities, fields, keep=keep).withColumn("own", F.create_map(F.lit("inline_root"), F.lit("true"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*out.columns))
    safe = safe_id(F.col("entity_id"))
    key = F.when(safe == F.col("entity_id"), safe).otherwise(F.concat(safe, F.lit("~"), F.substring(F.md5(F.col("entity_id").cast("binary")), 1, 8)))
    tail = F.when(F.col("type").isin("entity_fields", "field_fact"), F.format_string("%03d", "part"))
    out = out.select(F.concat_ws("::", "bundle", "type", key, tail).alias("doc_id"), *KEYS, "type", "part", "text", F.map_concat("base", "own").alias("metadata"))
    pages = glossary_docs(entities).select(
        F.concat_ws("::", "bundle", F.lit("glossary"), F.format_string("%03d", "number")).alias("doc_id"), "bundle", F.lit(None).cast("string").alias("entity_id"), F.lit("glossary").alias("type"), F.col("number").cast("int").alias("part"), "text",
        F.create_map(F.lit("chunk_index"), F.col("number").cast("string"), F.lit("chunk_total"), F.col("total").cast("string")).alias("metadata"),
    )
    return out.unionByName(pages)


def write_docs_jsonl(docs: DataFrame, path: str) -> None:
    """One JSON object per line, a folder per bundle and type."""
    docs.write.partitionBy("bundle", "type").json(path)
