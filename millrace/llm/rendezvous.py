"""Sharding by rendezvous hashing of record keys over weighted shards.

Each shard draws ``-ln(u) / weight`` for a key, with u from an md5 of key and shard number; the smallest draw wins.
A further shard can only win keys for itself, so growing moves about 1 / n of the records and none between old
shards. The key is the doc_id alone: rows with equal doc_id share a shard; a null doc_id counts as the text 'null'.

Draws are made once: a narrow table without texts is written and everything else comes from it. Slots are gapless in a
shard: rows are dealt by their place in that table into (shard, bucket) groups of bounded size, even where one doc_id
repeats without end, and each group starts after the counts of the groups before it, so no task holds a whole shard.
Null texts count 0 bytes and have the crc32 of the empty text. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm._common import materialise, table

OVERHEAD = 16
SHARDS = 40
#: Aimed-at rows of a (shard, bucket) group.
GROUP_ROWS = 4000


def _key(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit("null"))


def _draw(key: Column, shard: Column, weight: Column | float) -> Column:
    """What a shard draws for a key; the smallest draw wins."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary")), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 48)) / weight


def rendezvous_draw(key: Column, weights: list[float]) -> Column:
    """The winning draw ``d`` of a key and its shard ``i`` (from 0)."""
    shards = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    return F.array_min(F.transform(shards, lambda s: F.struct(_draw(key, s["i"], s["w"]).alias("d"), s["i"].alias("i"))))


def rendezvous_shard(key: Column, weights: list[float]) -> Column:
    """The shard (from 0) of a key."""
    return rendezvous_draw(key, weights)["i"]


def shard_documents(docs: DataFrame, shards: int = SHARDS, weights: list[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    weights = weights or [1.0] * shards
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), rendezvous_draw(_key("doc_id"), weights).alias("_w"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # the new shard either wins against the old winner's draw or changes nothing
    grown = F.when(_draw(_key("doc_id"), F.lit(len(weights)), grown_weight) < F.col("_w.d"), F.lit(len(weights))).otherwise(F.col("_w.i"))
    base = materialise(base.select("doc_id", "size", "text_crc32", "_row", F.col("_w.i").alias("shard"), grown.alias("grown_shard")), "shards")
    buckets = max(32, -(-base.count() // (len(weights) * GROUP_ROWS)))
    base = base.withColumn("_b", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int"))
    counts = base.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("shard", "_b", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("_row"))
    out = base.withColumn("_r", rank).join(before, ["shard", "_b"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_r") - 1).cast("long").alias("slot"), "grown_shard")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
