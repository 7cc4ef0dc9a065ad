"""Which schema files a bundle needs: include, import and ``$ref`` edges out of the files, followed from its entry files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.lineage import discard, written
from millrace.operators.detect import decode_text
from millrace.operators.graph import reachable
from millrace.operators.schema_ir import pointer_nodes, ref_target
from millrace.operators.schemas import xsd_nodes
from millrace.sources.files import read_named_files, read_raw_files

KINDS = ("include", "import", "ref")
_WHO = "bundle string, path string"


def schema_edges(files: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """``bundle, path, kind`` (include, import or ref)``, location, target`` of schema files (bundle, path, text).

    ``target`` is a path below the bundle's root, resolved against the file's own folder; a URL is what the catalogue
    (bundle, url, mapped) says, else null. References inside a file are no edges. A file that can't be parsed has none.
    """
    who = F.to_json(F.struct("bundle", "path"))
    nodes = xsd_nodes(files.select(who.alias("doc_id"), "text"))
    # only what stands directly below the schema element counts; that is the first node
    named = nodes.filter(F.col("tag").isin("include", "import") & (F.col("parent") == 0)).select(F.from_json("doc_id", _WHO).alias("w"), F.col("tag").alias("kind"), F.col("attrs")["schemaLocation"].alias("location"))
    named = named.select("w.bundle", "w.path", "kind", "location")
    ref = F.try_variant_get("v", "$['$ref']", "variant")
    refs = pointer_nodes(files).filter(F.schema_of_variant(ref) == "STRING").select("bundle", "path", F.lit("ref").alias("kind"), F.try_variant_get(ref, "$", "string").alias("location"))
    edges = named.unionByName(refs).filter(F.col("location") != "").distinct()
    urls = catalog if catalog is not None else edges.select("bundle", F.col("location").alias("url"), F.col("path").alias("mapped")).limit(0)
    edges = edges.join(urls.select("bundle", F.col("url").alias("location"), "mapped"), ["bundle", "location"], "left")
    edges = edges.withColumn("target", ref_target(F.col("path"), F.col("location"), F.col("mapped"))["path"])
    return edges.filter(~F.col("target").eqNullSafe(F.col("path"))).select("bundle", "path", "kind", "location", "target")


def schema_file_closure(files: DataFrame, entries: DataFrame, catalog: DataFrame | None = None, follow: tuple[str, ...] = KINDS) -> DataFrame:
    """``bundle, path`` of all files of a table that are reached from the entry files (bundle, path); the edges are taken once."""
    there = files.select("bundle", "path").distinct()
    edges = schema_edges(files, catalog).filter(F.col("kind").isin(*follow) & F.col("target").isNotNull())
    node = lambda path: F.to_json(F.struct("bundle", F.col(path).alias("path")))
    edges = written(edges.join(there.withColumnRenamed("path", "target"), ["bundle", "target"], "left_semi").select(node("path").alias("src"), node("target").alias("dst")).distinct(), "edges")
    starts = entries.join(there, ["bundle", "path"], "left_semi").select(F.col("bundle").alias("start"), node("path").alias("node"))
    reached = reachable(edges, starts).select(F.from_json("node", _WHO).alias("w")).select("w.*").distinct()
    out = written(reached, "closure")
    discard(edges)
    return out


def read_file_closure(spark: SparkSession, root: str, entries: list[str], catalog: dict[str, str] | None = None, follow: tuple[str, ...] = KINDS) -> DataFrame:
    """``bundle, path, round, text`` of the files below ``root`` that the entry files need; each is read once, in the round that finds it.

    ``catalog`` maps URLs to paths below the root. Only names of newly found files pass through the driver, as they do
    for any file that Spark reads; targets that don't exist are left out.
    """
    there = written(read_raw_files(spark, root, content=False).select(F.col("relative").alias("path")), "listing")
    urls = spark.createDataFrame([("", u, m) for u, m in (catalog or {}).items()], "bundle string, url string, mapped string")
    new = written(there.filter(F.col("path").isin(*entries) if entries else F.lit(False)), "frontier")
    seen, found, n = new, [], 0
    while names := [r.path for r in new.collect()]:
        rows = decode_text(read_named_files(spark, root, names)).select(F.lit("").alias("bundle"), F.col("relative").alias("path"), F.lit(n).alias("round"), "text")
        found.append(written(rows, "files"))
        targets = schema_edges(found[-1], urls).filter(F.col("kind").isin(*follow)).select(F.col("target").alias("path")).distinct()
        new = written(targets.join(there, "path", "left_semi").join(seen, "path", "left_anti"), "frontier")
        seen, n = written(seen.unionByName(new), "seen"), n + 1
    if not found:
        return spark.createDataFrame([], "bundle string, path string, round int, text string")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
