"""Reference graphs: reachability and bounded expansion by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.lineage import discard, written

#: Edges up to which (counted) they are broadcast in every round.
BROADCAST_EDGES = 500_000


def _small(edges: DataFrame) -> DataFrame:
    n = edges.limit(BROADCAST_EDGES + 1).count()
    return F.broadcast(edges) if n <= BROADCAST_EDGES else edges


def of_few(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose column is among ``ids``, if these are few (counted): found before anything is shuffled. Else all rows."""
    ids = ids.distinct()
    few = ids.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES
    return rows.join(F.broadcast(ids.toDF(column)), column, "left_semi") if few else rows


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, node`` for all nodes reached over edges (src, dst): semi-naive, only new pairs go on, until none is new.

    Starts are nodes; those with one ``start`` of their own are followed together.
    """
    edges = _small(edges.select("src", "dst").distinct())
    new = written(starts.select(F.col("start" if "start" in starts.columns else "node").alias("start"), "node").distinct(), "frontier")
    seen = new
    while True:
        found = new.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        fresh = written(found.join(seen, ["start", "node"], "left_anti"), "frontier")
        if not fresh.limit(1).count():
            return seen
        both = written(seen.unionByName(fresh), "seen")
        discard(new, seen)
        new, seen = fresh, both


def inline_entities(edges: DataFrame, entities: DataFrame, roots: DataFrame, max_depth: int | None = None, first: int | None = None) -> DataFrame:
    """Expands references from roots: ``root, path, depth, entity_id, role, status``, and ``places`` if edges have a ``pos``.

    status: ok, depth_cutoff (deeper than ``max_depth``, so not expanded), cycle (already on the path), missing (no such
    entity). A path never enters an entity twice, so without ``max_depth`` expansion ends by itself. Each level is
    written once and the next one starts from there.

    With ``first`` at least the first so many rows of each root are complete, in the order of ``places`` (a node before what
    is below it): of a level only that many can be among them, so shared sub-graphs, whose paths double from level to
    level, cost no more than rows that are shown; edges and entities that don't touch them are left out before any shuffle.
    """
    placed = "pos" in edges.columns
    edges = edges if placed else edges.withColumn("pos", F.lit(0))
    edges = _small(edges) if first is None else edges
    every = entities.select(F.col("entity_id").alias("_known"))

    def marked(rows: DataFrame, depth: int) -> DataFrame:
        known = every
        if first is not None:
            rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("root").orderBy("places", "path"))).filter(F.col("_n") <= first).drop("_n")
            rows = step = written(rows, "step")
            known = of_few(every, "_known", rows.select("entity_id"))
        cycle = F.array_contains(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))), F.col("entity_id"))
        rows = rows.join(known.distinct(), F.col("entity_id") == F.col("_known"), "left")
        status = F.when(F.lit(max_depth is not None and depth > (max_depth or 0)), "depth_cutoff").when(cycle, "cycle").when(F.col("_known").isNull(), "missing").otherwise("ok")
        rows = rows.select("root", "path", F.lit(depth).alias("depth"), "entity_id", "role", status.alias("status"), "places")
        out = written(rows, "level")
        if first is not None:
            discard(step)
        return out

    start = roots.select(F.col("entity_id").alias("root"), F.array("entity_id").alias("path"), "entity_id", F.lit("root").alias("role"), F.array().cast("array<int>").alias("places"))
    level = out = marked(start, 0)
    depth = 0
    while level.filter("status = 'ok'").limit(1).count():
        depth += 1
        grown = level.filter("status = 'ok'").select("root", "path", "places", F.col("entity_id").alias("at"))
        near = edges if first is None else of_few(edges, "src", grown.select("at"))
        step = grown.join(near, F.col("at") == F.col("src"))
        places = F.concat("places", F.array(F.col("pos").cast("int")))
        level = marked(step.select("root", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("entity_id"), "role", places.alias("places")), depth)
        out = out.unionByName(level)
    return out if placed else out.drop("places")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """``node``: all nodes on cycles, and those between cycles; ends are peeled off until every node has a way in and out."""
    left = written(edges.select("src", "dst").distinct(), "core")
    n = left.count()
    while n:
        inner = left.select(F.col("src").alias("node")).intersect(left.select(F.col("dst").alias("node")))
        inner = written(inner, "inner")
        kept = left.join(inner.select(F.col("node").alias("src")), "src", "left_semi").join(inner.select(F.col("node").alias("dst")), "dst", "left_semi")
        kept = written(kept.select("src", "dst"), "core")
        before, n = n, kept.count()
        discard(left, inner)
        left = kept
        if n == before:
            break
    return left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()


def inline_counts(edges: DataFrame, entities: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``root, depth, entity_id, role, status, n``: how many rows of ``inline_entities`` there are of each, without listing paths.

    What is below an entity depends on its path only through entities that can come again: those of the cyclic core. Rows
    with the same entity, role and core entities on their path are one row with a count, so a graph without cycles needs
    no more rows a level than it has edges, however many paths there are.
    """
    # every round reads them again: what makes them runs once
    edges = written(edges.select("src", "dst", "role"), "edges")
    rows_of = _small(edges)
    stored = written(entities.select(F.col("entity_id").alias("_known")).distinct(), "known")
    known = stored.hint("merge")
    core = written(cyclic_core(edges).select(F.col("node").alias("_core")), "core")

    def marked(rows: DataFrame, depth: int) -> DataFrame:
        rows = rows.groupBy("root", "entity_id", "role", "marks").agg(F.sum("n").alias("n"))
        rows = rows.join(known, F.col("entity_id") == F.col("_known"), "left").join(core, F.col("entity_id") == F.col("_core"), "left")
        status = F.when(F.lit(max_depth is not None and depth > (max_depth or 0)), "depth_cutoff").when(F.array_contains("marks", F.col("entity_id")), "cycle").when(F.col("_known").isNull(), "missing").otherwise("ok")
        marks = F.when(F.col("_core").isNotNull(), F.array_sort(F.array_union("marks", F.array("entity_id")))).otherwise(F.col("marks"))
        return written(rows.select("root", F.lit(depth).alias("depth"), "entity_id", "role", status.alias("status"), marks.alias("marks"), "n"), "counts")

    start = roots.select(F.col("entity_id").alias("root"), "entity_id", F.lit("root").alias("role"), F.array().cast("array<string>").alias("marks"), F.lit(1).cast("decimal(38,0)").alias("n"))
    level, depth = marked(start, 0), 0
    out = level
    while level.filter("status = 'ok'").limit(1).count():
        depth += 1
        step = level.filter("status = 'ok'").select("root", "marks", "n", F.col("entity_id").alias("at")).join(rows_of, F.col("at") == F.col("src"))
        level = marked(step.select("root", F.col("dst").alias("entity_id"), "role", "marks", F.col("n").cast("decimal(38,0)").alias("n")), depth)
        out = out.unionByName(level)
    discard(edges, stored, core)
    return out.groupBy("root", "depth", "entity_id", "role", "status").agg(F.sum("n").cast("decimal(38,0)").alias("n"))


INLINE_SQL = """
WITH RECURSIVE {edges}, known AS (SELECT DISTINCT src AS e FROM star_edges UNION SELECT dst FROM star_edges WHERE dst NOT LIKE 'missing:%'),
x AS (
    SELECT src AS root, [src] AS path, 0 AS depth, src AS entity_id, 'root' AS role, 'ok' AS status FROM (SELECT DISTINCT src FROM star_edges WHERE src LIKE 'region:%')
    UNION ALL
    SELECT x.root, list_append(x.path, e.dst), x.depth + 1, e.dst, e.role,
           CASE WHEN x.depth + 1 > 3 THEN 'depth_cutoff' WHEN list_contains(x.path, e.dst) THEN 'cycle' WHEN e.dst LIKE 'missing:%' THEN 'missing' ELSE 'ok' END
    FROM x JOIN star_edges e ON e.src = x.entity_id WHERE x.status = 'ok')
SELECT root, array_to_string(path, '>') AS path, depth, entity_id, role, status FROM x"""
