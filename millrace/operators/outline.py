"""Documents as outlines: a JSON tree becomes section rows, section rows become markdown.

A text is parsed once into nodes in the order of its sections (json_tree); types and examples are column expressions.
Nothing is shuffled before the sections of a document are put together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.lineage import discard, written
from millrace.operators.json_tree import json_nodes, property_rows

# fixed values: what counts as a date, a number in text, and cuts
DATE = r"^(\d{4}|\d{2})[-/](0[1-9]|1[0-2])[-/](0[1-9]|[12]\d|3[01])$"
INTEGER = r"^[+-]?\d+$"
FLOAT = r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"
EXAMPLE = 100
ENUMS = 20


def value_type(kind: Column, text: Column) -> Column:
    """object, list, integer, float, date or string of a JSON node; booleans and null count as strings."""
    named = F.when(kind == "array", "list").when(kind.isin("object", "integer", "float"), kind)
    return F.coalesce(named, F.when((kind == "string") & F.trim(text).rlike(DATE), "date").otherwise("string"))


def text_value_type(text: Column) -> Column:
    """The type of a scalar given as text: date, integer, float (with a point or exponent) or string."""
    t = F.trim(text)
    return F.when(t.rlike(DATE), "date").when(t.rlike(INTEGER), "integer").when(t.rlike(FLOAT) & t.rlike("[.eE]"), "float").otherwise("string")


def one_line(text: Column, most: int = EXAMPLE) -> Column:
    """White space collapsed, cut at ``most`` characters with '...'; nothing at all for 0."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.lit(most) == 0, "").when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("..."))).otherwise(flat)


def example_text(most: int = EXAMPLE, sample_lists: bool = True) -> Column:
    """A JSON node as a one-line example: null for objects, for lists a preview of what their first elements lead to."""
    leaf = lambda kind, text: F.when(kind == "string", one_line(text, most)).otherwise(text)
    levels, end = F.col("levels"), F.col("leaf_kind")
    inner = F.when(end == "object", "{...}").when(end == "array", "[]").otherwise(leaf(end, F.col("leaf")))
    shown = F.concat(F.repeat(F.lit("["), levels), inner, F.repeat(F.lit(", ...]"), levels)) if sample_lists else F.when(levels == 0, "[]").otherwise("[...]")
    return F.when(F.col("kind") == "array", shown).when(F.col("kind") != "object", leaf(F.col("kind"), F.col("value")))


def by_levels(level: DataFrame, below: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A first level and all levels below it; each is written once, the last is the first empty one."""
    level = out = written(level, "level")
    while True:
        level = written(below(level), "level")
        if not level.limit(1).count():
            discard(level)
            return out
        out = out.unionByName(level)


def children_of(rows: DataFrame) -> DataFrame:
    """Rows times the members of their variant ``v``: ``_pos, _key`` (null in lists)`` , _value``."""
    members = rows.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("_pos", "_key", "_value")
    return rows.lateralJoin(members)


def sections(docs: DataFrame, root: str, sample_lists: bool) -> DataFrame:
    """JSON nodes as sections: ``ord, name`` beside their columns; keys are sorted, of a list at most its first element shows."""
    nodes = json_nodes(docs, sort_keys=True, elements="first" if sample_lists else "none")
    return nodes.withColumn("ord", F.col("place")).withColumn("name", F.when(F.col("parent") < 0, root).otherwise(F.coalesce("key", F.lit("items"))))


def json_outline(docs: DataFrame, root: str = "json instance", most: int = EXAMPLE, sample_lists: bool = True) -> DataFrame:
    """``doc_id, ord, depth, name, type, example`` of every section of a JSON text.

    Texts that are no JSON give no rows.
    """
    rows = sections(docs, root, sample_lists)
    return rows.select("doc_id", "ord", "depth", "name", value_type(F.col("kind"), F.col("value")).alias("type"), example_text(most, sample_lists).alias("example"))


def render_markdown(sections: DataFrame) -> DataFrame:
    """``doc_id, markdown`` from section rows: headings, bullets, all lower-case; one shuffle by doc_id."""
    head = F.concat(F.repeat(F.lit("#"), F.least("depth", F.lit(6))), F.lit(" "), "name", F.lit("\n- type: "), "type")
    shown = F.when(F.col("example").isNotNull() & (F.col("example") != ""), F.concat(F.lit("\n- example: "), "example")).otherwise("")
    whole = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(head, shown).alias("md")))).alias("s"))
    return whole.select("doc_id", F.lower(F.concat(F.array_join(F.transform("s", lambda x: x["md"]), "\n\n"), F.lit("\n"))).alias("markdown"))


def schema_type(v: Column) -> Column:
    """The type text of a JSON Schema node."""
    get = lambda p, t="string": F.try_variant_get(v, p, t)
    many = F.array_join(F.array_sort(get("$.type", "array<string>")), " | ")
    has = lambda k: get(f"$.{k}", "variant").isNotNull()
    return F.coalesce(many, F.nullif(F.trim(get("$.type")), F.lit("")), F.concat(F.lit("ref "), F.try_variant_get(v, "$['$ref']", "string")), F.when(has("properties") | has("required"), "object").when(has("items"), "array").when(has("enum"), "enum").when(has("const"), "const"))


# fixed values: keywords in the order they are shown
CONSTRAINTS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "format", "minItems", "maxItems", "uniqueItems", "minProperties", "maxProperties", "additionalProperties", "default")


def schema_constraints(v: Column) -> Column:
    """The constraints of a JSON Schema node, joined by '; '."""
    parts = [F.concat(F.lit("$ref="), F.try_variant_get(v, "$['$ref']", "string"))]
    for k in CONSTRAINTS:
        value = F.try_variant_get(v, f"$.{k}", "string")
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
        if k == "additionalProperties":
            value = F.when(kind.startswith("OBJECT"), "schema").otherwise(F.initcap(value))
        elif k == "uniqueItems":
            value = F.initcap(value)
        parts.append(F.concat(F.lit(f"{k}="), value))
    return F.concat_ws("; ", *parts)


def enum_preview(values: Column, most: int = ENUMS) -> Column:
    """The first values in their order, and the total where some are left out."""
    n = F.size(values)
    total = F.concat(F.lit("... (total: "), n.cast("string"), F.lit(")"))
    if most == 0:
        return F.when(n > 0, total).otherwise("")
    return F.when(n <= most, F.array_join(values, ", ")).otherwise(F.concat(F.array_join(F.slice(values, 1, most), ", "), F.lit(", "), total))


def schema_fields(schemas: DataFrame) -> DataFrame:
    """Properties of JSON Schema texts as field rows, in the order of the file: type, constraints, required, enumeration, cardinality."""
    rows = property_rows(schemas.select("doc_id", "text")).select("doc_id", "pos", "name", "required", F.try_parse_json("own").alias("v"))
    kind = schema_type(F.col("v"))
    return rows.select(
        "doc_id", "pos", "name", kind.alias("type"), schema_constraints(F.col("v")).alias("constraints"), "required",
        F.coalesce(enum_preview(F.try_variant_get("v", "$.enum", "array<string>"), 3), F.lit("")).alias("enums"),
        F.when(F.col("required"), 1).otherwise(0).alias("card_min"), F.when(kind == "array", "*").otherwise("1").alias("card_max"),
    )


JSON_OUTLINE_SQL = """
o AS (SELECT doc_id, text::JSON AS j FROM order_json),
secs AS (
    SELECT doc_id, [] AS ord, 1 AS depth, 'json instance' AS name, 'object' AS type, NULL AS example FROM o
    UNION ALL SELECT doc_id, [0], 2, 'date', 'date', j->>'date' FROM o
    UNION ALL SELECT doc_id, [1], 2, 'lines', 'list', CASE WHEN json_array_length(j->'lines') > 0 THEN '[{...}, ...]' ELSE '[]' END FROM o
    UNION ALL SELECT doc_id, [1, 0], 3, 'items', 'object', NULL FROM o WHERE json_array_length(j->'lines') > 0
    UNION ALL SELECT doc_id, [1, 0, 0], 4, 'flag', 'string', j->'lines'->0->>'flag' FROM o WHERE json_array_length(j->'lines') > 0
    UNION ALL SELECT doc_id, [1, 0, 1], 4, 'part', 'integer', j->'lines'->0->>'part' FROM o WHERE json_array_length(j->'lines') > 0
    UNION ALL SELECT doc_id, [1, 0, 2], 4, 'qty', 'integer', j->'lines'->0->>'qty' FROM o WHERE json_array_length(j->'lines') > 0
    UNION ALL SELECT doc_id, [2], 2, 'order', 'integer', j->>'order' FROM o
    UNION ALL SELECT doc_id, [3], 2, 'priority', 'string', j->>'priority' FROM o
    UNION ALL SELECT doc_id, [4], 2, 'status', 'string', j->>'status' FROM o)"""
MARKDOWN_SQL = """
SELECT doc_id, lower(string_agg(repeat('#', least(depth, 6)) || ' ' || name || chr(10) || '- type: ' || type || coalesce(chr(10) || '- example: ' || example, ''), chr(10) || chr(10) ORDER BY ord) || chr(10)) AS markdown
FROM secs GROUP BY doc_id"""
