"""Scoring texts against label lists. Labels stay in arrays on the row: no shuffle of texts or pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = "This example is about {}."
ACCEPT = 0.7


def clean_labels(labels: Column) -> Column:
    """Trimmed, without empty ones and repeats, in first-seen order."""
    return F.array_distinct(F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def label_rejects(requests: DataFrame) -> DataFrame:
    """Adds cleaned ``labels`` and ``error`` where fewer than two are left."""
    return requests.withColumn("labels", clean_labels(F.col("labels"))).withColumn("error", F.when(F.size("labels") < 2, "fewer than two labels"))


def label_pairs(requests: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``doc_id, label, pos, hypothesis``: each text with each of its labels."""
    rows = requests.select("doc_id", F.posexplode_outer("labels").alias("pos", "label")).filter("label IS NOT NULL")
    return rows.withColumn("hypothesis", F.replace(F.lit(template), F.lit("{}"), F.col("label")))


def score_labels(logits: Column, multi_label: bool = False) -> Column:
    """Scores of an array of logits: softmax across labels, or each on its own by the logistic function."""
    if multi_label:
        return F.transform(logits, lambda x: 1 / (1 + F.exp(-x)))
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(logits, lambda x: F.exp(x - top) / total)


def top_k_labels(labels: Column, scores: Column, k: int | None = None) -> Column:
    """array<struct<score, pos, label>>, best first, ties by label position, the first k."""
    rows = F.zip_with(labels, F.transform(scores, lambda s, i: F.struct((-s).alias("neg"), i.alias("pos"))), lambda label, s: F.struct(s["neg"].alias("neg"), s["pos"].alias("pos"), label.alias("label")))
    ordered = F.transform(F.array_sort(rows), lambda r: F.struct((-r["neg"]).alias("score"), r["pos"].alias("pos"), r["label"].alias("label")))
    return ordered if k is None else F.slice(ordered, 1, k)


def accepted_labels(ranked: Column, least: float = ACCEPT) -> Column:
    return F.filter(ranked, lambda r: r["score"] > least)


def centroid_logits(vectors: DataFrame, sharpness: float = 60.0) -> DataFrame:
    """``doc_id, labels, logits``: the dot product of each vector with each label's mean vector.

    The means are one row per label (counted before they are broadcast as one array).
    """
    dims = F.posexplode("embedding").alias("d", "x")
    means = vectors.filter("label IS NOT NULL").select("label", dims).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    by_label = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda p: p["m"]).alias("m"))
    if by_label.limit(10_001).count() > 10_000:
        raise ValueError("too many labels for an array of means")
    table = by_label.agg(F.array_sort(F.collect_list(F.struct("label", "m"))).alias("all"))
    rows = vectors.crossJoin(F.broadcast(table))
    dot = lambda m: F.aggregate(F.zip_with("embedding", m, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, v: acc + v) * sharpness
    return rows.select(F.col("vec_id").alias("doc_id"), F.transform("all", lambda a: F.concat(F.lit("label_"), a["label"].cast("string"))).alias("labels"), F.transform("all", lambda a: dot(a["m"])).alias("logits"))


LOGITS_SQL = """
dims AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, d, avg(x) AS m FROM dims WHERE label IS NOT NULL GROUP BY ALL),
logits AS (SELECT vec_id AS doc_id, 'label_' || m.label AS label, (dense_rank() OVER (ORDER BY m.label) - 1) AS pos, sum(x * m) * 60.0 AS logit FROM dims v JOIN means m USING (d) GROUP BY vec_id, m.label),
soft AS (SELECT doc_id, label, pos, exp(logit - max(logit) OVER w) / sum(exp(logit - mx)) OVER w AS score, 1 / (1 + exp(-logit)) AS alone
         FROM (SELECT *, max(logit) OVER (PARTITION BY doc_id) AS mx FROM logits) WINDOW w AS (PARTITION BY doc_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM soft)"""
