"""Raw texts to markdown: detect, outline by kind, render; what can't be converted goes to a table of rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.lineage import written
from millrace.operators import classes, outline, schemas, trees
from millrace.operators.detect import KINDS, detect_kind
from millrace.operators.outline import ENUMS, EXAMPLE


def convert_to_markdown(docs: DataFrame, max_enums: int = ENUMS, max_example: int = EXAMPLE) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, kind, markdown``), (``doc_id, status, error, kind``) of rows (doc_id, text and perhaps error).

    Each text is in one of the two: 400 for a payload that was bad before, 415 where no kind is found, 500 where a parser
    gives up on a text of its kind (XML, XSD and YAML that are broken), 422 where the text is not what it looked like. The
    kinds are written once; each outline reads only its own.
    """
    rows = docs if "error" in docs.columns else docs.withColumn("error", F.lit(None).cast("string"))
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "error")
    found = written(detect_kind(rows.filter("error IS NULL")).select("doc_id", "text", "kind"), "kinds")
    of = lambda k: found.filter(F.col("kind") == k).select("doc_id", "text")
    kinds = {r.kind for r in found.select("kind").distinct().collect()}
    jobs = {
        KINDS[2]: lambda d: schemas.rendered(schemas.xsd_outline(d, max_enums)), KINDS[3]: lambda d: outline.render_markdown(trees.xml_outline(d, max_example)),
        KINDS[4]: lambda d: schemas.rendered(schemas.json_schema_outline(d, max_enums)), KINDS[5]: lambda d: outline.render_markdown(outline.json_outline(d, most=max_example)),
        KINDS[6]: lambda d: outline.render_markdown(trees.yaml_outline(d, max_example)),
    }
    parts = [job(of(k)).withColumn("kind", F.lit(k)) for k, job in jobs.items() if k in kinds]
    if kinds & {KINDS[0], KINDS[1]}:
        models = found.filter(F.col("kind").isin(KINDS[0], KINDS[1]))
        parts.append(classes.render_classes(classes.class_outline(models)).join(models.select("doc_id", "kind"), "doc_id"))
    out = found.select("doc_id", "kind", F.col("text").alias("markdown")).limit(0)
    for p in parts:
        out = out.unionByName(p.select("doc_id", "kind", "markdown"))
    out = written(out, "markdown")
    failed = found.join(out.select("doc_id"), "doc_id", "left_anti")
    crashed = F.col("kind").isin(KINDS[2], KINDS[3], KINDS[6])
    status = F.when(F.col("kind").isNull(), 415).when(crashed, 500).otherwise(422)
    error = F.when(F.col("kind").isNull(), "no kind fits").otherwise(F.concat(F.when(crashed, "conversion crashed as ").otherwise("not convertible as "), "kind"))
    rejects = failed.select("doc_id", status.alias("status"), error.alias("error"), "kind")
    return out, rejects.unionByName(rows.filter("error IS NOT NULL").select("doc_id", F.lit(400).alias("status"), "error", F.lit(None).cast("string").alias("kind")))
