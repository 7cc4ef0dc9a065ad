"""Lines that many documents share are kept once: range-partitioned hashes, streamed in order of document and position.

1. One pass hashes every line whose key (stripped of ASCII space, A-Z lower-cased) is long enough: 128 bits, the document
   and the line's number; texts do not travel.
2. Hashes of more than ``HOT_ROWS`` lines are settled by grouped counts alone, combined before they are shuffled: a line
   that a third of all documents share meets in no task.
3. All other hashes are range-partitioned and sorted by hash, document (largest first) and position. One stream over
   each range numbers the documents of a hash: the lines of the first stay, those of the others go if there are enough.
   The windows reuse the ranges and their order; nothing is exchanged or sorted again.
4. The dropped line numbers of a document become its keep bitmap in run form (as the run containers of compressed
   bitmaps: first line and length of every kept run). ``keep_bitmaps`` returns these, no text; ``apply_bitmaps`` cuts texts
   by them. Documents that lose nothing have no bitmap.

Defined cases: a null or empty text is one empty line; rows with one doc_id are one document, and rows equal in doc_id
and text get equal results; rows without a doc_id are together one document, smaller than all others; keys compare by
code points; a line repeated inside the keeping document stays each time; an empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm._common import discard, hinted, materialise, table, text_key

#: Code points a key needs, and documents that must hold it.
MIN_CHARS = 40
MIN_DOCS = 5
#: Lines of one hash that a stream takes; hashes of more lines are settled by grouped counts, with the same result.
HOT_ROWS = 2_000
#: Rows of hot hashes (40 bytes each) up to which they are broadcast; shuffled beyond.
BROADCAST_ROWS = 500_000
SPACE = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, tk, h1, h2, pos``: a row for every line with a key of at least ``min_chars``."""
    lowered = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    # what stands beside a generator is computed for each of its rows: the text's hash comes before it
    lines = docs.select("doc_id", text_key("text").alias("tk"), lines_of(lowered).alias("lines")).select("doc_id", "tk", F.posexplode_outer("lines").alias("pos", "line"))
    lines = lines.select("doc_id", "tk", "pos", F.btrim("line", F.lit(SPACE)).alias("key")).filter(F.char_length("key") >= min_chars)
    return lines.select("doc_id", "tk", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "pos")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, list[DataFrame]]:
    """``doc_id, tk, pos`` of the lines that go, and the tables that can be discarded when these have been read."""
    key = ["h1", "h2"]
    lines = materialise(hashed_lines(docs, min_chars), "lines")
    hot = materialise(lines.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows).select(key), "hot")
    hot = hinted(hot, hot.count(), BROADCAST_ROWS)

    # a hot hash: its distinct documents are counted and its largest found by sums that are combined in every task
    held = materialise(lines.join(hot, key), "held")
    documents = held.groupBy(*key, "doc_id").agg(F.lit(1).alias("one"))
    heads = documents.groupBy(key).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= min_docs)
    heads = materialise(heads.select(*key, "keeper"), "heads")
    from_hot = held.join(hinted(heads, heads.count(), BROADCAST_ROWS), key).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))

    # all others: a stream in order of hash, document and position
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("pos")]
    ordered = lines.join(hot, key, "left_anti").repartitionByRange(n, *key).sortWithinPartitions(*key, *order)
    streamed = ordered.withColumn("nth", F.dense_rank().over(Window.partitionBy(*key).orderBy(order[0])))
    streamed = streamed.withColumn("n_docs", F.max("nth").over(Window.partitionBy(*key)))
    from_others = streamed.filter((F.col("nth") > 1) & (F.col("n_docs") >= min_docs))

    columns = ["doc_id", "tk", "pos"]
    return from_hot.select(columns).unionByName(from_others.select(columns)), [lines, held, heads]


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``doc_id, tk, n_dropped, keep``: for each document that loses lines the runs (first line, length) of those it keeps.

    ``tk`` is the text's hash: it tells rows apart that share a doc_id. The last run's length is -1: to the end.
    """
    dropped, used = dropped_lines(docs, min_chars, min_docs, hot_rows)
    # equal rows name the same lines
    gone = dropped.groupBy("doc_id", "tk").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    at = lambda i: F.get("gone", i)
    index = F.sequence(F.lit(0), F.size("gone"))
    # a kept run starts behind each dropped line and ends before the next one
    runs = F.transform(index, lambda i: F.struct(F.coalesce(at(i - 1) + 1, F.lit(0)).alias("first"), F.coalesce(at(i) - F.coalesce(at(i - 1) + 1, F.lit(0)), F.lit(-1)).alias("length")))
    out = materialise(gone.select("doc_id", "tk", F.size("gone").cast("long").alias("n_dropped"), F.filter(runs, lambda r: r["length"] != 0).alias("keep")), "bitmaps")
    discard(*used)
    return out


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with ``_n_lines``, ``_n_dropped`` and ``_kept``, the lines that stay joined by a line feed."""
    theirs = bitmaps.select(F.col("doc_id").alias("_d"), F.col("tk").alias("_k"), F.col("n_dropped").alias("_dropped"), F.col("keep").alias("_keep"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), text_key("text").alias("_tk"))
    joined = rows.join(theirs, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_tk") == F.col("_k")), "left")
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    lines = lines_of(F.col("_row.text"))
    kept = F.flatten(F.transform("_keep", lambda r: F.slice("_lines", r["first"] + 1, F.when(r["length"] < 0, F.size("_lines")).otherwise(r["length"]))))
    joined = joined.withColumn("_lines", F.when(F.col("_dropped").isNotNull(), lines))
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return joined.select(
        "_row.*", n_lines.cast("long").alias("_n_lines"), F.coalesce("_dropped", F.lit(0).cast("long")).alias("_n_dropped"),
        F.when(F.col("_dropped").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("_kept"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = apply_bitmaps(docs.select("doc_id", "text"), keep_bitmaps(docs))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT rid, k.doc_id, line, pos, r.key IS NOT NULL AND k.doc_id <> keeper AS gone FROM k LEFT JOIN r USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""
