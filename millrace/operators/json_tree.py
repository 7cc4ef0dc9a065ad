"""JSON texts as node tables: one parse of each text, nodes in pre-order with the size of their subtree.

Keys keep the order of the file (or are sorted on demand), a number keeps being an integer or a float, of repeated keys
the last value stands in the place of the first. Nothing is written or shuffled: a text's nodes leave the task that read it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.batches import text_rows

NODES = "node int, parent int, size int, depth int, pos int, place array<int>, key string, kind string, value string, levels int, leaf_kind string, leaf string"
_TYPES = {"int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def loaded(text: str) -> tuple[bool, Any]:
    """(whether it is JSON, the value)."""
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


def clean(text: str) -> str:
    """Text that can be encoded: halves of surrogate pairs become question marks."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def kind_of(v: Any) -> str:
    """object, array, string, integer, float, boolean or null."""
    if isinstance(v, dict):
        return "object"
    if isinstance(v, list):
        return "array"
    if v is None:
        return "null"
    return "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "integer" if isinstance(v, int) else "float"


def scalar_text(v: Any) -> str | None:
    if v is None or isinstance(v, dict | list):
        return "null" if v is None else None
    return clean(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def flatten(value: Any, sort_keys: bool = False, elements: str = "all") -> Iterator[tuple[int, int, list[int], str | None, Any]]:
    """(node, parent, place, key, value) in pre-order; ``elements`` of arrays: all, first or none."""
    waiting, n = [(-1, [], None, value)], 0
    while waiting:
        parent, place, key, v = waiting.pop()
        yield n, parent, place, key, v
        if isinstance(v, dict):
            members = sorted(v.items()) if sort_keys else list(v.items())
        elif isinstance(v, list):
            members = [(None, x) for x in (v if elements == "all" else v[:1] if elements == "first" else [])]
        else:
            members = []
        waiting += [(n, [*place, i], *members[i]) for i in range(len(members) - 1, -1, -1)]
        n += 1


def first_leaf(v: Any) -> tuple[int, str, str | None]:
    """How many arrays lie around an array's first element, and what that is."""
    levels = 0
    while isinstance(v, list) and v:
        v, levels = v[0], levels + 1
    return levels, kind_of(v), scalar_text(v)


def json_nodes(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), sort_keys: bool = False, elements: str = "all") -> DataFrame:
    """Key columns and ``node, parent, size, depth, pos, place, key, kind, value, levels, leaf_kind, leaf`` of JSON texts.

    ``place`` are the positions on the way from the root; ``leaf`` is what the first elements of nested arrays lead to.
    Texts that aren't JSON give no rows.
    """

    def rows(text: str) -> Iterator[tuple]:
        good, value = loaded(text)
        if not good:
            return
        nodes = list(flatten(value, sort_keys, elements))
        sizes = [1] * len(nodes)
        for n, parent, *_ in reversed(nodes):
            if parent >= 0:
                sizes[parent] += sizes[n]
        for n, parent, place, key, v in nodes:
            yield n, parent, sizes[n], len(place) + 1, place[-1] if place else 0, place, None if key is None else clean(key), kind_of(v), scalar_text(v), *first_leaf(v)

    types = [c.split(" ") for c in NODES.split(", ")]
    given = {f.name: f.dataType.simpleString() for f in docs.schema if f.name in keys}
    known = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(k, known[given[k]]) for k in keys] + [(n, _TYPES[t]) for n, t in types])
    return docs.select(*keys, "text").mapInArrow(text_rows(rows, list(keys), schema), ", ".join(f"{k} {given[k]}" for k in keys) + ", " + NODES)


def last_keys(text: str | None) -> str | None:
    """The JSON text with the last of repeated keys; null where it is no JSON."""
    good, value = loaded(text) if text else (False, None)
    return json.dumps(value) if good else None


def parsed(text: Column) -> Column:
    """A variant of a JSON text; one with repeated keys, which variants refuse, is parsed with the last of each.

    Spark's parser stops behind the first value and ignores what follows. So the text is parsed as the first of two
    elements: the second, its own digest, is found right behind it only if the text was that one value and nothing else.
    """
    mark = F.md5(text)
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    v = F.when(F.try_variant_get(both, "$[1]", "string") == mark, F.try_variant_get(both, "$[0]", "variant"))
    refused = F.when(v.isNull() & text.rlike(r"^\s*[\[{]"), text)
    return F.coalesce(v, F.try_parse_json(F.pandas_udf(lambda s: s.map(last_keys), "string")(refused)))


def property_rows(schemas: DataFrame) -> DataFrame:
    """``doc_id, pos, name, required, own`` (its schema's JSON text): the properties of JSON Schema texts in the order of the file."""

    def rows(text: str) -> Iterator[tuple]:
        good, schema = loaded(text)
        if good and isinstance(schema, dict) and isinstance(schema.get("properties"), dict):
            asked = schema.get("required")
            asked = {x for x in asked if isinstance(x, str)} if isinstance(asked, list) else set()
            for i, (name, own) in enumerate(schema["properties"].items()):
                yield i, clean(name), name in asked, json.dumps(own)

    kind = schemas.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("doc_id", pa.int64() if kind == "bigint" else pa.string()), ("pos", pa.int32()), ("name", pa.string()), ("required", pa.bool_()), ("own", pa.string())])
    return schemas.select("doc_id", "text").mapInArrow(text_rows(rows, ["doc_id"], schema), f"doc_id {kind}, pos int, name string, required boolean, own string")


#: Keywords whose values are data: they stay whole where schemas and containers of schemas are left to rows of their own.
DATA = ("enum", "const", "default", "examples")


def _own(schema: dict) -> dict:
    """An object without what its own rows say: objects below it are empty."""

    def short(key: str, v: Any) -> Any:
        if key in DATA:
            return v
        return {} if isinstance(v, dict) else [{} if isinstance(x, dict) else [] if isinstance(x, list) else x for x in v] if isinstance(v, list) else v

    return {k: short(k, v) for k, v in schema.items()}


def pointer(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def schema_objects(files: DataFrame) -> DataFrame:
    """``bundle, path, ptr, own, names`` of all objects in JSON files: their pointer (``#/a/0/b``), their own text, their property names in order.

    What lies below an object is left to its own rows, so each text is written about once.
    """

    def rows(text: str) -> Iterator[tuple]:
        good, value = loaded(text)
        if not good or not isinstance(value, dict):
            return
        ptrs: list[str] = []
        for _, parent, place, key, v in flatten(value):
            ptrs.append("#" if parent < 0 else f"{ptrs[parent]}/{place[-1] if key is None else pointer(key)}")
            if isinstance(v, dict):
                props = v.get("properties")
                yield clean(ptrs[-1]), json.dumps(_own(v)), [clean(k) for k in props] if isinstance(props, dict) else []

    text = pa.string()
    schema = pa.schema([("bundle", text), ("path", text), ("ptr", text), ("own", text), ("names", pa.list_(text))])
    return files.select("bundle", "path", "text").mapInArrow(text_rows(rows, ["bundle", "path"], schema), "bundle string, path string, ptr string, own string, names array<string>")
