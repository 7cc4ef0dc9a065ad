"""Expansion of shared sub-graphs: counted, or only as far as it is shown."""

import random

from pyspark.sql import functions as F
from conftest import SF
from millrace.jobs import registry
from millrace.operators import docs, graph


def tables(spark, edges):
    rows = [(a, b, "field", i + 1) for i, (a, b) in enumerate(edges)]
    ids = sorted({x for e in edges for x in e if not x.startswith("?")})
    return spark.createDataFrame(rows, "src string, dst string, role string, pos int"), spark.createDataFrame([(x,) for x in ids], "entity_id string")


def diamonds(levels):
    return [(f"n{i}", f"{side}{i}") for i in range(levels) for side in "ab"] + [(f"{side}{i}", f"n{i + 1}") for i in range(levels) for side in "ab"]


def test_many_diamonds_are_counted(spark):
    edges, entities = tables(spark, diamonds(20))
    got = {(r.depth, r.entity_id): int(r.n) for r in graph.inline_counts(edges, entities, entities.filter("entity_id = 'n0'")).collect()}
    assert got == {(2 * i, f"n{i}"): 2**i for i in range(21)} | {(2 * i + 1, f"{s}{i}"): 2**i for i in range(20) for s in "ab"}


def test_the_first_lines_of_many_diamonds(spark):
    edges, entities = tables(spark, diamonds(20))
    rows = graph.inline_entities(edges, entities, entities.filter("entity_id = 'n0'"), first=50).orderBy("places").limit(50).collect()
    places = {(a, b): i + 1 for i, (a, b) in enumerate(diamonds(20))}
    want, waiting = [], [("n0", [])]
    while waiting and len(want) < 50:
        node, at = waiting.pop()
        want.append((node, at))
        waiting += [(b, [*at, p]) for (a, b), p in sorted(places.items(), key=lambda x: -x[1]) if a == node]
    assert [(r.entity_id, list(r.places)) for r in rows] == want


def test_small_graphs_agree(spark):
    draw = random.Random(8)
    for size in (5, 7):
        edges, entities = tables(spark, sorted({(draw.choice("abcdef"[:size]), draw.choice(["?x", *"abcdef"[:size]])) for _ in range(size * 2)}))
        for depth in (None, 3):
            every = graph.inline_entities(edges, entities, entities, depth)
            want = {tuple(r) for r in every.groupBy("root", "depth", "entity_id", "role", "status").agg(F.count(F.lit(1)).alias("n")).collect()}
            assert {(*tuple(r)[:-1], int(r.n)) for r in graph.inline_counts(edges, entities, entities, depth).collect()} == want
        plain = every.orderBy("root", "places").collect()
        cut = graph.inline_entities(edges, entities, entities, 3, first=6)
        for root in {r.root for r in plain}:
            assert [r.path for r in cut.filter(F.col("root") == root).orderBy("places").limit(6).collect()] == [r.path for r in plain if r.root == root][:6]


def test_cyclic_core(spark):
    edges, _ = tables(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("e", "e"), ("e", "f"), ("x", "y")])
    assert {r.node for r in graph.cyclic_core(edges).collect()} == {"b", "c", "d", "e"}
    assert graph.cyclic_core(edges.limit(0)).count() == 0


def test_levels_hold_no_more_than_shown_lines(spark, monkeypatch):
    levels, real = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: levels.append(real(df, name)) or levels[-1] if name == "level" else real(df, name))
    monkeypatch.setattr(docs, "INLINE_LINES", 10)
    assert registry.QUERIES["entity_inline_docs"](spark, SF).count() == 25
    assert len(levels) == 4 and all(r["count"] <= 10 for level in levels for r in level.groupBy("root").count().collect())


def test_counts_take_the_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)
    note = F.udf(lambda x: seen.add(1) or x, "string")
    edges = spark.createDataFrame([("a", "b", "field"), ("b", "c", "field"), ("c", "d", "field"), ("d", "b", "field"), ("a", "e", "field")], "src string, dst string, role string")
    known = spark.createDataFrame([(x,) for x in "abcde"], "entity_id string")
    rows = graph.inline_counts(edges.withColumn("dst", note("dst")), known, known.filter("entity_id = 'a'")).collect()
    assert seen.value == 5 and {(r.depth, r.entity_id, r.status) for r in rows} == {(0, "a", "ok"), (1, "b", "ok"), (1, "e", "ok"), (2, "c", "ok"), (3, "d", "ok"), (4, "b", "cycle")}
