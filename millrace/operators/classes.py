"""Python model files as outlines: one row per model class, and the order in which classes depend on each other."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.lineage import written
from millrace.operators.detect import KINDS

CLASSES = "doc_id string, kind string, ord array<int>, name string, parent string, code string, uses array<string>"
_NAME = re.compile(r"\w+")
# fixed values: titles of the two kinds of files
TITLES = {KINDS[0]: "pydantic models", KINDS[1]: "dataclass models"}


def _uncommented(source: str) -> str:
    tokens = tokenize.generate_tokens(io.StringIO(source).readline)
    return tokenize.untokenize(t for t in tokens if t.type != tokenize.COMMENT)


def _is_model(c: ast.ClassDef, kind: str) -> bool:
    """A BaseModel subclass, or a class with the dataclass decorator; bare or behind a module's name."""
    nodes, wanted = (c.bases, "BaseModel") if kind == KINDS[0] else (c.decorator_list, "dataclass")
    plain = (n.func if isinstance(n, ast.Call) else n for n in nodes)
    return any(getattr(n, "id", getattr(n, "attr", None)) == wanted for n in plain)


def _class_rows(doc_id: str, kind: str, text: str) -> Iterator[tuple]:
    try:
        source = _uncommented(text)
        body = ast.parse(source).body
    except (SyntaxError, ValueError, RecursionError, MemoryError, tokenize.TokenError):
        return
    waiting = [(c, [i], c.name, None) for i, c in enumerate(body) if isinstance(c, ast.ClassDef)]
    while waiting:
        c, place, name, parent = waiting.pop()
        if not _is_model(c, kind):
            continue
        notes = (n.annotation for n in ast.walk(c) if isinstance(n, ast.AnnAssign | ast.arg) and n.annotation is not None)
        uses = sorted({word for n in notes for word in _NAME.findall(ast.unparse(n))})
        yield doc_id, kind, place, name, parent, (ast.get_source_segment(source, c) or "").rstrip(), uses
        waiting += [(x, [*place, i], f"{name}.{x.name}", name) for i, x in enumerate(c.body) if isinstance(x, ast.ClassDef)]


def class_outline(files: DataFrame) -> DataFrame:
    """``doc_id, kind, ord, name, parent, code, uses``: model classes of files (doc_id, kind, text).

    Comments are dropped; nested models follow their parent; ``uses`` are the words of all annotations inside.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for d, k, t in zip(f["doc_id"], f["kind"], f["text"], strict=True) for r in _class_rows(d, k, t)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "ord", "name", "parent", "code", "uses"])

    models = files.filter(F.col("kind").isin(*TITLES) & F.col("text").isNotNull())
    return models.select(F.col("doc_id").cast("string").alias("doc_id"), "kind", "text").mapInPandas(run, CLASSES)


def class_dependency_order(classes: DataFrame) -> DataFrame:
    """``doc_id, name, round``: a class comes in a later round than the top-level classes that it names.

    Classes of a round are ordered by name. Where a file has a cycle and so nothing to take, its smallest name is taken.
    Each round is one join over what is left in all files.
    """
    top = classes.filter("parent IS NULL").groupBy("doc_id", "name").agg(F.max_by("uses", "ord").alias("uses"))
    left = written(top, "classes")
    edges = left.select("doc_id", "name", F.explode("uses").alias("on")).join(left.select("doc_id", F.col("name").alias("on")), ["doc_id", "on"]).filter("on <> name")
    edges, out, turn = written(edges, "uses"), left.select("doc_id", "name", F.lit(0).alias("round")).limit(0), 0
    left = left.select("doc_id", "name")
    while left.limit(1).count():
        waits = edges.join(left.select("doc_id", F.col("name").alias("on")), ["doc_id", "on"], "left_semi").select("doc_id", "name").distinct()
        ready = left.join(waits, ["doc_id", "name"], "left_anti")
        stuck = left.join(ready.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(F.min("name").alias("name"))
        taken = written(ready.unionByName(stuck).withColumn("round", F.lit(turn)), "round")
        out, left, turn = out.unionByName(taken), written(left.join(taken, ["doc_id", "name"], "left_anti"), "left"), turn + 1
    return out


def render_classes(classes: DataFrame) -> DataFrame:
    """``doc_id, markdown``: sections with code, top-level classes in dependency order; lower-case but for dataclasses."""
    classes = written(classes, "classes")
    order = class_dependency_order(classes).withColumnRenamed("name", "top")
    short = F.element_at(F.split("name", r"\."), -1)
    section = F.concat(F.repeat(F.lit("#"), F.least(F.size("ord") + 1, F.lit(6))), F.lit(" "), short, F.lit("\n```python\n"), "code", F.lit("\n```\n"))
    rows = classes.select("doc_id", "kind", "ord", F.element_at(F.split("name", r"\."), 1).alias("top"), section.alias("md")).join(order, ["doc_id", "top"])
    whole = rows.groupBy("doc_id", "kind").agg(F.array_sort(F.collect_list(F.struct("round", "top", "ord", "md"))).alias("s"))
    title = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])[F.col("kind")]
    text = F.concat(F.lit("# "), title, F.lit("\n\n"), F.rtrim(F.array_join(F.transform("s", lambda x: x["md"]), "\n"), F.lit("\n ")), F.lit("\n"))
    return whole.select("doc_id", F.when(F.col("kind") == KINDS[0], F.lower(text)).otherwise(text).alias("markdown"))
