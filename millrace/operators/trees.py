"""XML and YAML documents as outline rows.

A small helper turns a text into raw node rows (XML) or JSON text (YAML); sampling of repeated siblings, typing, examples
and ordering are column expressions, and rendering is shared with JSON.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.batches import text_rows
from millrace.operators.outline import EXAMPLE, example_text, one_line, sections, text_value_type, value_type

NODES = "doc_id string, ord array<int>, many array<int>, name string, text string, inner boolean"
_ARROW = pa.schema([("doc_id", pa.string()), ("ord", pa.list_(pa.int32())), ("many", pa.list_(pa.int32())), ("name", pa.string()), ("text", pa.string()), ("inner", pa.bool_())])
#: Marks a native YAML date: it is text, not a date in the outline's sense.
NATIVE = "\u0001"


def _nodes(text: str) -> Iterator[tuple]:
    """Elements and attributes: place and number among siblings of their name, for the whole path; of those siblings the first."""
    local = lambda tag: tag.rpartition("}")[2]
    try:
        root = ElementTree.fromstring(text)
    except (ElementTree.ParseError, ValueError):
        return
    waiting = [(root, [0], [1])]
    while waiting:
        e, ord_, many = waiting.pop()
        yield ord_, many, local(e.tag), e.text or "", bool(len(e) or e.attrib)
        for i, k in enumerate(sorted(e.attrib)):
            yield [*ord_, i], [*many, 1], "@" + local(k), e.attrib[k], False
        names = [local(c.tag) for c in e]
        sizes, first = Counter(names), {}
        for i, name in enumerate(names):
            first.setdefault(name, i)
        waiting += [(e[i], [*ord_, len(e.attrib) + i], [*many, sizes[name]]) for name, i in first.items()]


def xml_nodes(docs: DataFrame) -> DataFrame:
    """Raw node rows of XML texts; texts that aren't XML give none."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(text_rows(_nodes, ["doc_id"], _ARROW), NODES)


def xml_outline(docs: DataFrame, most: int = EXAMPLE) -> DataFrame:
    """``doc_id, ord, depth, name, type, example``: repeated siblings become a list at their first place with one sample."""
    nodes = xml_nodes(docs)
    # every repeated ancestor adds the level of its sample
    extra = F.aggregate("many", F.lit(0), lambda a, m: a + (m > 1).cast("int"))
    repeated = F.element_at("many", -1) > 1
    place = F.flatten(F.zip_with("ord", "many", lambda o, m: F.when(m > 1, F.array(o, F.lit(0))).otherwise(F.array(o))))
    shown = one_line(F.col("text"), most)
    scalar = F.when(F.col("inner"), "object").otherwise(text_value_type(F.col("text")))
    depth = F.size("ord") + extra
    own = F.struct(place.alias("ord"), depth.alias("depth"), F.when(repeated, "items").otherwise(F.col("name")).alias("name"), scalar.alias("type"), F.nullif(shown, F.lit("")).alias("example"))
    inside = F.when(F.col("inner") | (shown == ""), "{...}").otherwise(shown)
    upper = F.slice(place, F.lit(1), F.size(place) - 1)
    lists = F.struct(upper.alias("ord"), (depth - 1).alias("depth"), F.col("name").alias("name"), F.lit("list").alias("type"), F.concat(F.lit("["), inside, F.lit(", ...]")).alias("example"))
    # a text is parsed once: a repeated node is two rows
    rows = nodes.select("doc_id", F.explode_outer(F.array(own, F.when(repeated, lists))).alias("s"))
    return rows.filter("s IS NOT NULL").select("doc_id", "s.*")


def _yaml_to_json(text: str | None) -> str | None:
    import yaml

    try:
        return None if text is None else json.dumps(yaml.safe_load(text), default=lambda v: NATIVE + str(v), allow_nan=False)
    except (yaml.YAMLError, ValueError, TypeError, RecursionError):
        return None


def _yaml_type(kind: Column, text: Column) -> Column:
    return F.when((kind == "string") & text.startswith(NATIVE), "string").when(kind == "string", text_value_type(text)).otherwise(value_type(kind, text))


def yaml_outline(docs: DataFrame, most: int = EXAMPLE, sample_lists: bool = True) -> DataFrame:
    """As json_outline, from YAML: quoted numbers and dates are typed by their text, native dates are strings."""
    as_json = F.pandas_udf(lambda s: s.map(_yaml_to_json), "string")
    rows = sections(docs.select("doc_id", as_json("text").alias("text")), "yaml instance", sample_lists)
    example = F.replace(example_text(most, sample_lists), F.lit(NATIVE), F.lit(""))
    return rows.select("doc_id", "ord", "depth", "name", _yaml_type(F.col("kind"), F.col("value")).alias("type"), example.alias("example"))
