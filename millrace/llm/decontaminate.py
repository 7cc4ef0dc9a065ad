"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Windows are ``window`` consecutive item words (one shorter window for a shorter item). A window occurs in a
document exactly if all its word shingles do, in place, so one shingle of each window is a sufficient prefix:

1. One pass over the corpus keeps the positions of shingles that some window has (an inverted list restricted
   to the benchmark's vocabulary) and so gives exact corpus counts; a mark of its own brings every document's word count.
2. Each window's shingles are ordered by that rarity; its rarest one is joined with the lists.
3. Length and position bounds drop windows that would start before or end after the document.
4. The remaining (document, start, window) candidates are compared word by word with the document. Only texts of
   documents with candidates are read for that; all others travel as a key and a count.

Defined cases: null or wordless texts have no words and are clean; an item without words has no window; repeated
documents give repeated rows; repeated items share windows and are all reported; null item_ids are not reported
in the list but their windows hit; with an empty benchmark all documents are clean. Extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import hinted, materialise, text_key

WINDOW = 10
SHINGLE = 5
#: Rows up to which tables of hashes and counts are broadcast (8 to 24 bytes a row); shuffled beyond.
BROADCAST_ROWS = 2_000_000
#: Rows of windows with their words and items up to which they are broadcast, if their bytes stay below the next bound.
BROADCAST_WINDOWS = 200_000
BROADCAST_BYTES = 64 << 20
#: Stands for the end of a document in its list of shingles.
MARK = 0
#: Everything that is not a word character, after A-Z have become a-z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """Words of a whole text: A-Z lower-cased, runs of digits, letters and non-ASCII characters."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def _shifted(name: str, by: int) -> Column:
    return F.slice(name, by + 1, F.size(name))


def with_shingles(df: DataFrame, words: str, sizes: list[int]) -> DataFrame:
    """Adds ``_sh``: hashes of all shingles, those of ``sizes[0]`` first; built by doubling, a few passes a row."""
    pair = lambda a, b: F.xxhash64(a, b)
    df = df.withColumn("_h1", F.transform(words, lambda w: F.xxhash64(w))).withColumn("_n", F.size("_h1").cast("long"))
    need = max(sizes)
    if need >= 2:
        df = df.withColumn("_h2", F.zip_with("_h1", _shifted("_h1", 1), pair))
    if need >= 3:
        df = df.withColumn("_h3", F.zip_with("_h2", _shifted("_h1", 2), pair)) if 3 in sizes else df
    if need >= 4:
        df = df.withColumn("_h4", F.zip_with("_h2", _shifted("_h2", 2), pair))
    if need >= 5:
        df = df.withColumn("_h5", F.zip_with("_h4", _shifted("_h1", 4), pair))
    parts = [F.slice(f"_h{k}", F.lit(1), F.greatest(F.size("_h1") - (k - 1), F.lit(0))) for k in sizes]
    df = df.withColumn("_sh", parts[0] if len(parts) == 1 else F.concat(*parts))
    return df.drop("_h1", "_h2", "_h3", "_h4", "_h5")


def _position(sizes: list[int]) -> tuple[Column, Column]:
    """From the index in ``_sh`` and the word count: the shingle's size and its word position."""
    size, pos, base = F.lit(sizes[-1]), None, F.lit(0).cast("long")
    bounds = []
    for k in sizes:
        bounds.append((k, base))
        base = base + F.greatest(F.col("_n") - (k - 1), F.lit(0))
    pos = F.col("_i") - bounds[-1][1]
    for (k, start), (_, end) in reversed(list(zip(bounds, bounds[1:], strict=False))):
        size = F.when(F.col("_i") < end, F.lit(k)).otherwise(size)
        pos = F.when(F.col("_i") < end, F.col("_i") - start).otherwise(pos)
    return size.cast("int"), pos.cast("int")


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``wtext`` (words joined by a space), ``w_len``, ``k`` (shingle size), ``items``."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), word_array(F.col(text_col)).alias("w"))
    items = items.withColumn("n", F.size("w")).filter("n > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))
    wins = items.select("item", "n", "w", F.explode(starts).alias("s"))
    wins = wins.select("item", F.least("n", F.lit(window)).alias("w_len"), F.array_join(F.slice("w", F.col("s") + 1, F.least("n", F.lit(window))), " ").alias("wtext"))
    return wins.groupBy("wtext", "w_len").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("k", F.least("w_len", F.lit(SHINGLE)))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    keep: bool = False,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items, contaminated``.

    With ``keep``: ``_row`` (all its columns), ``n_words`` (null where nothing hit), ``n_hit, contaminated``.
    """
    spark = docs.sparkSession
    wins = materialise(benchmark_windows(benchmark, item_col, item_text_col, window), "windows")
    sizes = sorted((r.k for r in wins.select("k").distinct().collect()), reverse=True) or [SHINGLE]

    parts = with_shingles(wins.withColumn("_w", F.split("wtext", " ")), "_w", sizes)
    size, pos = _position(sizes)
    shingles = parts.select("wtext", "w_len", "items", "k", "_n", F.posexplode("_sh").alias("_i", "h")).select("wtext", "w_len", "items", "k", "h", size.alias("size"), pos.alias("off")).filter("size = k").drop("size", "k")
    shingles = materialise(shingles, "shingles")
    # one more "shingle" in every document's list brings its word count
    vocabulary = materialise(shingles.select("h").unionByName(spark.range(1).select(F.lit(MARK).cast("long").alias("h"))).distinct(), "vocabulary")
    n_vocabulary = vocabulary.count()

    base = docs.select(F.col(doc_col).alias("_doc"), text_key(text_col).alias("_tk"), word_array(F.col(text_col)).alias("_w"))
    # the outer form: for the inner one Catalyst infers a filter on the array's size and computes the array twice
    exploded = with_shingles(base, "_w", sizes).withColumn("_sh", F.concat("_sh", F.array(F.lit(MARK).cast("long")))).select("_doc", "_tk", "_n", F.posexplode_outer("_sh").alias("_i", "h"))
    size, pos = _position(sizes)
    last = F.lit(0).cast("long")
    for k in sizes:
        last = last + F.greatest(F.col("_n") - (k - 1), F.lit(0))
    known = exploded.join(hinted(vocabulary, n_vocabulary, BROADCAST_ROWS), "h", "left_semi")
    listed = materialise(known.select("_doc", "_tk", "_n", "h", pos.alias("pos"), (F.col("_i") == last).alias("end")), "lists")
    lists = listed.filter("NOT end").drop("end")

    rarity = lists.groupBy("h").agg(F.count(F.lit(1)).alias("seen"))
    prefix = shingles.join(hinted(rarity, n_vocabulary, BROADCAST_ROWS), "h")
    # a window with a shingle that occurs nowhere can't occur
    prefix = prefix.groupBy("wtext").agg(
        F.min(F.struct("seen", "off", "h")).alias("p"), F.count(F.lit(1)).alias("found"), F.first("w_len").alias("w_len"), F.first("items").alias("items"),
        F.first(F.size(F.split("wtext", " "))).alias("words"),
    ).filter(F.col("found") == F.col("words") - F.least("words", F.lit(SHINGLE)) + 1)
    prefix = materialise(prefix.select("wtext", "w_len", "items", F.col("p.h").alias("h"), F.col("p.off").alias("off")), "prefix")
    sizes_of = prefix.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("wtext") + 16 * F.size("items")).alias("bytes")).first()
    small = (sizes_of.bytes or 0) <= BROADCAST_BYTES
    cands = lists.join(hinted(prefix, sizes_of.n, BROADCAST_WINDOWS if small else -1), "h").withColumn("start", F.col("pos") - F.col("off"))
    cands = cands.filter("start >= 0 and start + w_len <= _n")
    cands = materialise(cands.groupBy("_doc", "_tk").agg(F.collect_set(F.struct("start", "w_len", "wtext", "items")).alias("_c")), "candidates")

    n_cands = cands.count()
    asked = cands.select(F.col("_doc").alias("_ad"), F.col("_tk").alias("_ak"))
    work = docs.select(F.col(doc_col).alias("_d"), F.col(text_col).alias("_t"), text_key(text_col).alias("_k"))
    work = work.join(hinted(asked, n_cands, BROADCAST_ROWS), F.col("_d").eqNullSafe(F.col("_ad")) & (F.col("_k") == F.col("_ak")), "left_semi").dropDuplicates(["_d", "_k"])
    joined = work.join(cands, F.col("_d").eqNullSafe(F.col("_doc")) & (F.col("_k") == F.col("_tk"))).withColumn("_w", word_array(F.col("_t")))
    same = lambda c: F.array_join(F.slice("_w", c["start"] + 1, c["w_len"]), " ") == c["wtext"]
    joined = joined.withColumn("_v", F.array_sort(F.filter("_c", same)))

    def cover(acc, c):
        end = c["start"] + c["w_len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["hit"] + F.greatest(end - F.greatest(acc["end"], c["start"]), F.lit(0))).cast("long").alias("hit"))

    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))
    hit = F.aggregate("_v", zero, cover, lambda a: a["hit"])
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("_v", lambda c: c["items"]))))
    # the words are used twice, else Catalyst would move their expression into the filter and split a text for every candidate
    joined = joined.withColumn("_words", F.size("_w").cast("long"))
    hits = materialise(joined.select(F.col("_d").alias("_hd"), F.col("_k").alias("_hk"), "_words", hit.alias("n_hit"), items.alias("items")).filter("n_hit > 0"), "hits")
    same_doc = lambda d, k: F.col(d).eqNullSafe(F.col("_hd")) & (F.col(k) == F.col("_hk"))
    counts = listed.filter("end").select("_doc", "_tk", F.col("_n").alias("n_words"))
    if keep:
        row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(doc_col).alias("_doc"), text_key(text_col).alias("_tk"))
        found = hits.select("_hd", "_hk", "n_hit", F.col("_words").alias("n_words"))
        out = row.join(hinted(found, n_cands, BROADCAST_ROWS), same_doc("_doc", "_tk"), "left")
        return out.select("_row", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.col("n_hit").isNotNull().alias("contaminated"))
    out = counts.join(hits.drop("_words"), same_doc("_doc", "_tk"), "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("_doc").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_hit_share: float = 0.0, min_hit: int = 1) -> DataFrame:
    """Documents without benchmark windows (or below both limits), with all their columns."""
    scored = contamination(docs, benchmark, keep=True)
    bad = (F.col("n_hit") >= min_hit) & (F.col("n_hit") > max_hit_share * F.coalesce("n_words", F.lit(0)))
    return scored.filter(~bad).select("_row.*")


def op10(spark, sf_dir: str) -> DataFrame:
    from millrace.llm._common import table

    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH
d AS (SELECT doc_id, row_number() OVER () AS rid,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents),
b AS (SELECT item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS t
       FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, rid, l, s, array_to_string(w[s + 1 : s + l], ' ') AS t
       FROM (SELECT doc_id, rid, w, l, unnest(range(0, len(w) - l + 1)) AS s FROM d, lens WHERE len(w) >= l)),
m AS (SELECT rid, s, dw.l, item_id FROM dw JOIN bw USING (t)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + l)) AS p FROM m) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM m WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
