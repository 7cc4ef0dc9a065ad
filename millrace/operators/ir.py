"""The entity tables: ids, references, sources, merging, examples, mappings, counts, nested output and back.

Tables: entities(bundle, entity_id, kind, name, description, source_file), fields(bundle, entity_id, pos, name,
type_prim, type_ref, ...), relations(bundle, entity_id, pos, role, target), constraints(bundle, entity_id, field_name,
pos, kind, and what the kind needs), edges(bundle, src, dst, role, pos).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["bundle", "entity_id"]


def safe_id(text: Column) -> Column:
    """Trimmed; white space and runs of other unusual characters become one underscore each."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", "_"), r"[^A-Za-z0-9_.:#/-]+", "_")


def short_id(entity_id: Column) -> Column:
    """What follows the last '#', else the last part between '/' and ':'."""
    return F.when(F.contains(entity_id, F.lit("#")), F.element_at(F.split(entity_id, "#"), -1)).otherwise(F.element_at(F.split(entity_id, "[/:]+"), -1))


def display_name(name: Column, entity_id: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), short_id(entity_id))


def cardinality_text(low: Column, high: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(low, F.lit(0)).cast("string"), F.lit(".."), F.coalesce(high.cast("string"), F.lit("*")), F.lit("]"))


def type_text(prim: Column, ref: Column) -> Column:
    return F.coalesce(F.concat(F.lit("ref:"), short_id(ref)), prim, F.lit("any"))


def entity_edges(fields: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Reference edges ``bundle, src, dst, role, pos``: of fields, and of relations (bundle, entity_id, pos, role, target).

    Roles of relations are extends, element (of an array) and choice (an option of a union).
    """
    out = fields.filter("type_ref IS NOT NULL").select("bundle", F.col("entity_id").alias("src"), F.col("type_ref").alias("dst"), F.lit("field").alias("role"), "pos")
    if relations is None:
        return out
    relations = relations.filter("is_ref") if "is_ref" in relations.columns else relations
    return out.unionByName(relations.filter("target IS NOT NULL").select("bundle", F.col("entity_id").alias("src"), F.col("target").alias("dst"), "role", "pos"))


def entity_refs(edges: DataFrame) -> DataFrame:
    """``bundle, entity_id, refs``: distinct references, sorted."""
    return edges.groupBy("bundle", F.col("src").alias("entity_id")).agg(F.array_sort(F.collect_set("dst")).alias("refs"))


def entity_sources(entities: DataFrame, locators: DataFrame) -> DataFrame:
    """``bundle, entity_id, files``: from the annotation and from provenance locators (before ' :: '), sorted."""
    own = entities.select(*KEYS, F.trim("source_file").alias("f"))
    more = locators.select(*KEYS, F.trim(F.element_at(F.split("locator", " :: "), 1)).alias("f"))
    return own.unionByName(more).filter("f <> ''").groupBy(*KEYS).agg(F.array_sort(F.collect_set("f")).alias("files"))


def bundle_counts(entities: DataFrame, fields: DataFrame, constraints: DataFrame) -> DataFrame:
    """Per bundle: entities, source files by kind, fields, constraints."""
    e = entities.groupBy("bundle").agg(F.count(F.lit(1)).alias("entities"), F.count_distinct(F.when(F.col("source_file").endswith(".json"), F.col("source_file"))).alias("json_files"), F.count_distinct(F.when(F.col("source_file").endswith(".xsd"), F.col("source_file"))).alias("xsd_files"))
    f = fields.groupBy("bundle").agg(F.count(F.lit(1)).alias("fields"))
    c = constraints.groupBy("bundle").agg(F.count(F.lit(1)).alias("constraints"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return e.join(f, "bundle", "left").join(c, "bundle", "left").select("bundle", "entities", "json_files", "xsd_files", zero("fields"), zero("constraints"))


def merge_entities(first: DataFrame, second: DataFrame, source_id: str) -> DataFrame:
    """Two origins in one id space: a colliding id of the second gets ``source_id:`` before it; repeats: the last wins.

    Rows carry ``ord``, their place of insertion.
    """
    taken = first.select("bundle", "entity_id").distinct().withColumn("_hit", F.lit(True))
    moved = second.join(taken, KEYS, "left").withColumn("entity_id", F.when(F.col("_hit"), F.concat(F.lit(source_id + ":"), "entity_id")).otherwise(F.col("entity_id"))).drop("_hit")
    both = first.withColumn("_o", F.lit(0)).unionByName(moved.withColumn("_o", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("_o"), F.desc("ord")))
    return both.withColumn("_r", last).filter("_r = 1").drop("_r", "_o", "ord")


def enrich_with_examples(entities: DataFrame, examples: DataFrame) -> DataFrame:
    """``bundle, entity_id, examples``: examples whose hint equals a token of the id, without case.

    Hints are few next to tokens: tokens that no hint has are dropped before anything is shuffled by token.
    """
    hints = examples.select(F.lower("hint").alias("token"), "example_id")
    words = F.explode(F.array_distinct(F.transform(F.filter(F.split("entity_id", r"[#.:/]+"), lambda t: t != ""), F.lower)))
    tokens = entities.select(*KEYS, words.alias("token"))
    return tokens.join(hints, "token").groupBy(*KEYS).agg(F.array_sort(F.collect_set("example_id")).alias("examples"))


def example_hints(files: DataFrame) -> DataFrame:
    """``bundle, file, kind, hint`` of example files (bundle, path, text): the only key of a JSON object, the root's name of an XML text.

    Which one is asked by the file's ending; other files, other JSON values and texts that can't be parsed give no hint.
    """
    from xml.etree import ElementTree

    def root(text: str | None) -> str | None:
        try:
            return None if text is None else ElementTree.fromstring(text).tag.rpartition("}")[2]
        except (ElementTree.ParseError, ValueError):
            return None

    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    keys = F.array_distinct(F.json_object_keys(F.when(kind == "json", F.col("text"))))
    of_xml = F.pandas_udf(lambda s: s.map(root), "string")(F.when(kind == "xml", F.col("text")))
    hint = F.when(kind == "json", F.when(F.size(keys) == 1, keys[0])).otherwise(of_xml)
    return files.select("bundle", name.alias("file"), kind.alias("kind"), hint.alias("hint"), "path").filter("hint IS NOT NULL")


def examples_index(entities: DataFrame, hints: DataFrame) -> DataFrame:
    """``bundle, entity_id, examples`` (file, kind, hint, by path): the bundle's examples whose hint is a token of the id, without case.

    A token's examples are gathered before entities meet them: one row a token, so a frequent token's entities can be split.
    """
    by_token = hints.groupBy("bundle", F.lower("hint").alias("token")).agg(F.collect_list(F.struct("path", "file", "kind", "hint")).alias("of"))
    words = F.array_distinct(F.transform(F.filter(F.split("entity_id", r"[#.:/]+"), lambda t: t != ""), F.lower))
    tokens = entities.select(*KEYS, F.explode_outer(words).alias("token")).join(by_token, ["bundle", "token"])
    met = tokens.groupBy(*KEYS).agg(F.array_sort(F.flatten(F.collect_list("of"))).alias("of"))
    return met.select(*KEYS, F.transform("of", lambda x: F.struct(x["file"].alias("file"), x["kind"].alias("kind"), x["hint"].alias("hint"))).alias("examples"))


def apply_mappings(rules: DataFrame, entities: DataFrame) -> DataFrame:
    """Rules (from_bundle, from_entity, to_bundle, to_entity, relation) of known source entities, with ``warning``
    where the target bundle is loaded but lacks the entity."""
    ids = entities.select("bundle", "entity_id").distinct()
    loaded = entities.select(F.col("bundle").alias("_loaded")).distinct()
    kept = rules.join(ids, (F.col("from_bundle") == F.col("bundle")) & (F.col("from_entity") == F.col("entity_id")), "left_semi")
    there = ids.select(F.col("bundle").alias("to_bundle"), F.col("entity_id").alias("to_entity"), F.lit(True).alias("_there"))
    out = kept.join(there, ["to_bundle", "to_entity"], "left").join(loaded, F.col("to_bundle") == F.col("_loaded"), "left")
    return out.withColumn("warning", F.when(F.col("_loaded").isNotNull() & F.col("_there").isNull(), "target entity missing")).drop("_loaded", "_there")


def entity_mappings(mapped: DataFrame) -> DataFrame:
    """``bundle, entity_id, mappings``: applied mappings as a list per source entity, ordered by target: what its IR says of them."""
    record = F.struct("to_bundle", "to_entity", "relation", "warning")
    return mapped.groupBy(F.col("from_bundle").alias("bundle"), F.col("from_entity").alias("entity_id")).agg(F.array_sort(F.collect_list(record)).alias("mappings"))


def resolve_names(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References (bundle, ns, local) to the symbol of the smallest ``rank``; null where there is none."""
    best = symbols.groupBy("bundle", "ns", "local").agg(F.min(F.struct("rank", "entity_id")).alias("s"))
    return refs.join(best, ["bundle", "ns", "local"], "left").withColumn("entity_id", F.col("s.entity_id")).drop("s")


def select_entrypoints(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed files of bundles that list any, else all files of the bundle."""
    has = listed.select("bundle").distinct()
    return files.join(listed, ["bundle", "path"], "left_semi").unionByName(files.join(has, "bundle", "left_anti"))


def select_inline_roots(entities: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Entities asked for by exact id, or without case by name or short id (column ``wanted``, blanks around it don't count).

    Without a list: the entities that have been expanded before (column ``inlined``), none where that is unknown.
    """
    if wanted is None:
        return entities.filter(F.col("inlined") if "inlined" in entities.columns else F.lit(False)).select(*KEYS).distinct()
    name = display_name(F.col("name"), F.col("entity_id"))
    rows = entities.select(*KEYS, F.explode(F.array(F.concat(F.lit("id:"), "entity_id"), F.concat(F.lit("n:"), F.lower(name)), F.concat(F.lit("n:"), F.lower(short_id(F.col("entity_id")))))).alias("k"))
    asked = wanted.select(F.trim("wanted").alias("wanted")).filter("wanted <> ''")
    keys = asked.select(F.explode(F.array(F.concat(F.lit("id:"), "wanted"), F.concat(F.lit("n:"), F.lower("wanted")))).alias("k")).distinct()
    return rows.join(keys, "k", "left_semi").select(*KEYS).distinct()


def nested_entities(entities: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per entity with its fields as an ordered array: the form that is written out."""
    own = fields.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "type_prim", "type_ref", "required"))).alias("fields"))
    return entities.join(own, KEYS, "left")


def flat_fields(nested: DataFrame) -> DataFrame:
    """The way back: ``bundle, entity_id, pos, name, type_prim, type_ref, required``."""
    return nested.select(*KEYS, F.explode_outer("fields").alias("f")).filter("f IS NOT NULL").select(*KEYS, "f.*")
