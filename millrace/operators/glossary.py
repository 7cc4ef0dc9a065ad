"""Glossary pages of a bundle: entries by name, packed greedily to a character budget, at any size.

Greedy packing looks sequential: where a page begins depends on where the one before ended. Here it is a jump from each
entry, were it the first of a page, to the first entry of the next page. Prefix sums of line lengths over sorted ranges
give that entry by binary search inside blocks of a bounded number of characters; jumps are doubled inside a block until
they leave it, so each entry knows the first entry of a later block that starts a page and the pages in between. Few
entries of a block are ever such targets, and the hops between them are doubled again from the bundle's first entry. No
step sees more than a block's entries, however large a bundle is; the driver sees no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.lineage import discard, written
from millrace.operators.ir import display_name

# fixed values: characters of a page and of a shortened description
GLOSSARY_CHARS, DESCRIPTION = 8000, 120
TOP, MORE = "# Glossary", " (cont.)"
#: Pages' worth of characters in a block of entries.
BLOCK_PAGES = 32


def glossary_lines(entities: DataFrame) -> DataFrame:
    """``bundle, name_key, entity_id, line``."""
    name, text = display_name(F.col("name"), F.col("entity_id")), F.trim("description")
    short = F.when(F.length(text) > DESCRIPTION, F.concat(F.substring(text, 1, DESCRIPTION), F.lit("…"))).otherwise(text)
    tail = F.when(short != "", F.concat(F.lit(" — "), short)).otherwise("")
    return entities.select("bundle", F.lower(name).alias("name_key"), "entity_id", F.concat(F.lit("- "), name, F.lit(" ("), "kind", F.lit(") id="), "entity_id", F.coalesce(tail, F.lit(""))).alias("line"))


def _placed(lines: DataFrame, max_chars: int) -> DataFrame:
    """Adds ``i`` (rank in its bundle), ``at`` and ``end`` (its characters among all of the bundle) and ``block``."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["name_key", "entity_id"]
    ranged = written(lines.repartitionByRange(n, "bundle", *order).withColumn("slice", F.spark_partition_id()).withColumn("chars", (F.length("line") + 1).cast("long")), "ranges")
    before = Window.partitionBy("bundle").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each bundle and range
    slices = ranged.groupBy("bundle", "slice").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("c"))
    slices = slices.select("bundle", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("i0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    inside = Window.partitionBy("bundle", "slice").orderBy(*order)
    rows = ranged.join(slices, ["bundle", "slice"]).withColumn("i", F.col("i0") + F.row_number().over(inside) - 1).withColumn("end", F.col("c0") + F.sum("chars").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # the first page has the shorter title: its only possible first entry counts as standing that much further on
    at = F.when(F.col("i") == 0, len(MORE)).otherwise(F.col("end") - F.col("chars"))
    rows = rows.select("bundle", "i", "line", at.cast("long").alias("at"), "end").withColumn("block", F.floor(F.col("at") / (BLOCK_PAGES * max_chars)))
    out = written(rows, "placed")
    discard(ranged)
    return out


def _jumps(frame: pd.DataFrame) -> pd.DataFrame:
    """One block and what follows within a page: for each own entry its next page, and the first page behind the block."""
    frame = frame.sort_values("i", ignore_index=True)
    at, end, own = frame["at"].to_numpy(), frame["end"].to_numpy(), int(frame["own"].sum())
    limit = at[:own] + frame["budget"].to_numpy()[:own]
    last = np.searchsorted(at, limit, side="right") - 1
    # two entries stand on any page; the last entry of all may end before the limit
    step = np.maximum(np.arange(own) + 2, last + (end[last] <= limit))
    out, pages = step.copy(), np.ones(own, dtype=np.int64)
    while (inner := np.flatnonzero(out < own)).size:
        pages[inner], out[inner] = pages[inner] + pages[out[inner]], out[out[inner]]
    first = frame["i"].iloc[0]
    return pd.DataFrame({"bundle": pd.array([frame["bundle"].iloc[0]] * own, dtype=object), "block": frame["block"].to_numpy()[:own], "i": first + np.arange(own), "next": first + step, "out": first + out, "pages": pages})


def _walk(frame: pd.DataFrame) -> pd.DataFrame:
    """The pages of one block from its first page's entry on."""
    frame = frame.sort_values("i", ignore_index=True)
    first, nexts = frame["i"].iloc[0], frame["next"].to_numpy()
    at, number, rows = int(frame["enter"].iloc[0] - first), int(frame["before"].iloc[0]), []
    while at < len(nexts):
        number += 1
        rows.append((frame["bundle"].iloc[0], number, first + at, nexts[at]))
        at = int(nexts[at] - first)
    return pd.DataFrame(rows, columns=["bundle", "number", "start", "next"])


def _first_pages(hops: DataFrame) -> DataFrame:
    """``bundle, i, before``: where a page starts first in each block, and the pages before; hops are doubled."""
    reached = hops.filter("i = 0").select("bundle", "i", F.lit(0).cast("long").alias("before"))
    # hops that end behind the bundle's last entry lead nowhere
    step = written(hops.join(hops.select("bundle", F.col("i").alias("out")), ["bundle", "out"], "left_semi").select("bundle", "i", "out", "pages"), "hops")
    used = []
    while step.limit(1).count():
        further = reached.join(step, ["bundle", "i"]).select("bundle", F.col("out").alias("i"), (F.col("before") + F.col("pages")).alias("before"))
        both = written(reached.unionByName(further), "reached")
        onward = step.select("bundle", F.col("i").alias("out"), F.col("out").alias("_out"), F.col("pages").alias("_pages"))
        double = written(step.join(onward, ["bundle", "out"]).select("bundle", "i", F.col("_out").alias("out"), (F.col("pages") + F.col("_pages")).alias("pages")), "hops")
        discard(step, *used)
        used, reached, step = [both], both, double
    discard(step)
    return reached


def glossary_pages(lines: DataFrame, max_chars: int = GLOSSARY_CHARS) -> tuple[DataFrame, DataFrame]:
    """``bundle, number, start, next`` (ranks of the first entry and of the one behind the last) and the entries by rank."""
    placed = _placed(lines, max_chars)
    width = BLOCK_PAGES * max_chars
    budget = max_chars - 1 - F.length(F.concat(F.lit(f"{TOP}{MORE}\nBundle: "), "bundle"))
    ahead = F.col("at") - F.col("block") * width <= max_chars
    seats = F.filter(F.array(F.struct(F.col("block").alias("block"), F.lit(True).alias("own")), F.when(ahead, F.struct((F.col("block") - 1).alias("block"), F.lit(False).alias("own")))), lambda x: x.isNotNull())
    rows = placed.select("bundle", "i", "at", "end", budget.cast("long").alias("budget"), F.explode(seats).alias("s")).select("bundle", "i", "at", "end", "budget", "s.block", "s.own")
    jumps = written(rows.groupBy("bundle", "block").applyInPandas(_jumps, "bundle string, block long, i long, next long, out long, pages long"), "jumps")
    targets = jumps.select("bundle", F.col("out").alias("i")).unionByName(jumps.filter("i = 0").select("bundle", "i")).distinct()
    hops = written(jumps.join(targets, ["bundle", "i"], "left_semi").select("bundle", "block", "i", "out", "pages"), "targets")
    reached = _first_pages(hops)
    entered = hops.join(reached, ["bundle", "i"]).select("bundle", "block", F.col("i").alias("enter"), "before")
    pages = written(jumps.join(entered, ["bundle", "block"]).groupBy("bundle", "block").applyInPandas(_walk, "bundle string, number long, start long, next long"), "pages")
    discard(jumps, hops, reached)
    return pages, placed


def glossary_docs(entities: DataFrame, max_chars: int = GLOSSARY_CHARS) -> DataFrame:
    """``bundle, number, total, text``: the pages of each bundle; only the first has the title without a mark."""
    pages, placed = glossary_pages(glossary_lines(entities), max_chars)
    # a page stands for all its entries here: by the few bytes of its row Spark would broadcast them all
    members = placed.join(pages.select("bundle", "number", F.explode(F.sequence("start", F.col("next") - 1)).alias("i")).hint("merge"), ["bundle", "i"])
    texts = members.groupBy("bundle", "number").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))
    totals = pages.groupBy("bundle").agg(F.max("number").alias("total"))
    top = F.concat(F.when(F.col("number") == 1, TOP).otherwise(TOP + MORE), F.lit("\nBundle: "), "bundle", F.lit("\n"))
    return texts.join(totals, "bundle").select("bundle", "number", "total", F.concat(top, F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


#: Pages from a table ``lines(bundle, name_key, entity_id, line)``; the query that uses it is WITH RECURSIVE.
GLOSSARY_SQL = f"""
g AS (SELECT bundle, line, length(line) + 1 AS n, row_number() OVER (PARTITION BY bundle ORDER BY name_key, entity_id) - 1 AS i FROM lines),
p AS (SELECT *, (sum(n) OVER (PARTITION BY bundle ORDER BY i))::BIGINT AS e,
             {GLOSSARY_CHARS} - 1 - length('{TOP}' || CASE WHEN i = 0 THEN '' ELSE '{MORE}' END || chr(10) || 'Bundle: ' || bundle) - n AS room FROM g),
j AS (SELECT bundle, i, greatest(i + 2, (SELECT count(*) FROM p q WHERE q.bundle = p.bundle AND q.e <= p.e + p.room)) AS next, max(i) OVER (PARTITION BY bundle) AS last FROM p),
r AS (SELECT DISTINCT bundle, 1 AS number, 0::BIGINT AS start FROM p
      UNION ALL SELECT r.bundle, r.number + 1, j.next FROM r JOIN j ON j.bundle = r.bundle AND j.i = r.start WHERE j.next <= j.last)
SELECT r.bundle, r.number::BIGINT AS number, (max(r.number) OVER (PARTITION BY r.bundle))::BIGINT AS total,
       CASE WHEN r.number = 1 THEN '{TOP}' ELSE '{TOP}{MORE}' END || chr(10) || 'Bundle: ' || r.bundle || chr(10) || string_agg(p.line, chr(10) ORDER BY p.i) || chr(10) AS text
FROM r JOIN j ON j.bundle = r.bundle AND j.i = r.start JOIN p ON p.bundle = r.bundle AND p.i >= r.start AND p.i < j.next
GROUP BY r.bundle, r.number
"""
