"""Spelling variants: words of a corpus that differ by one edit, grouped below their most frequent neighbour.

An even-partition pigeonhole join. A word of length l is indexed by its two halves, cut at l // 2; a word of length l or
l + 1 is one insertion or replacement away only if one half occurs in it, the first in place, the second in place or
shifted by one. Put as a window: the edit lies in one half, everything before and behind it must agree. An entry's key is
therefore (l, window, what precedes it, what follows it); of two equally long words the smaller one probes, of a word of
length l + 1 the rest behind the window is read one place later.

Candidates are verified by their exact edit distance inside the join, then deduplicated: an insertion beside an equal
letter is found by both halves. Entries of a bucket with many candidate pairs are not joined: their window is halved
again, for that bucket alone, until it holds few pairs or is one letter wide. Then all words of a bucket differ in this
letter only, so candidates are bounded by the alphabet and nearly all of them are results; nothing is cut off.

``form`` is a word's most frequent neighbour if that is at least ``RATIO`` times as frequent, ``root`` the end of the
chain of forms. Counts grow along a chain, so chains are short and end; they are followed by doubling.

Defined cases: null texts have no words, and a null doc_id damages none; ties go to the smaller word in code-point order;
repeated rows count as often as they stand; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import discard, hinted, materialise, table

#: Code points and occurrences that make a run a word; how many times as frequent a form is.
MIN_CHARS = 7
MIN_COUNT = 2
RATIO = 10
#: Candidate pairs of a bucket from which its windows are halved again.
BUCKET_PAIRS = 20_000
#: Keys of such buckets (8 bytes each) up to which they are broadcast; shuffled beyond.
BROADCAST_ROWS = 500_000
#: What separates runs of letters.
NOT_LETTER = "[^A-Za-zÀ-ÿ]+"
DAMAGE = 31


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def letter_runs(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """Runs of letters of a whole text, A-Z lower-cased; those too short to matter are left out."""
    return F.filter(F.split(lowered(F.coalesce(text, F.lit(""))), NOT_LETTER), lambda w: F.char_length(w) >= min_chars)


def damaged(doc_id: Column, run: Column, every: int = DAMAGE) -> Column:
    """The run without one letter, for one in ``every`` pairs of document and run."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(runs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the runs (column ``word``) that are long and frequent enough."""
    return runs.filter(F.char_length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds ``key``: the hash of length, window [a, b) and what stands around it."""
    before, behind = F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.col("b") + F.col("longer") + 1, F.char_length("word"))
    return rows.withColumn("key", F.xxhash64("l", "a", "b", before, behind))


def _halved(rows: DataFrame) -> DataFrame:
    """Every entry once with each half of its window."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    halves = F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))
    return _keyed(rows.select("word", "n", "l", "longer", F.explode(halves).alias("w")).select("word", "n", "l", "longer", "w.a", "w.b"))


def near_words(words: DataFrame, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """``word, n, near, near_n``: all ordered pairs of words that are exactly one edit apart."""
    length = F.char_length("word")
    roles = F.filter(F.array(F.struct(length.alias("l"), F.lit(0).alias("longer")), F.struct((length - 1).alias("l"), F.lit(1).alias("longer"))), lambda x: x["l"] > 0)
    level = words.select("word", "n", F.explode(roles).alias("x")).select("word", "n", "x.l", "x.longer", F.lit(0).alias("a"), F.col("x.l").alias("b"))
    level, found = materialise(_halved(level), "entries"), []
    used = [level]
    while True:
        own, all_of = F.sum(1 - F.col("longer")), F.count(F.lit(1))
        many = level.groupBy("key").agg(own.alias("own"), all_of.alias("all"), F.max(F.col("b") - F.col("a")).alias("width"))
        many = materialise(many.filter((F.col("own") * F.col("all") > bucket_pairs) & (F.col("width") > 1)).select("key"), "wide")
        used.append(many)
        n_many = many.count()
        few = level.join(hinted(many, n_many, BROADCAST_ROWS), "key", "left_anti") if n_many else level
        index = few.filter("longer = 0").select("key", F.col("word").alias("left"), F.col("n").alias("left_n"))
        probe = few.select("key", "longer", F.col("word").alias("right"), F.col("n").alias("right_n"))
        once = (F.col("longer") == 1) | (F.col("left") < F.col("right"))
        pairs = index.join(probe, (index["key"] == probe["key"]) & once & (F.levenshtein("left", "right", 1) == 1)).select("left", "left_n", "right", "right_n")
        found.append(materialise(pairs, "near"))
        if not n_many:
            break
        level = materialise(_halved(level.join(hinted(many, n_many, BROADCAST_ROWS), "key", "left_semi")), "entries")
        used.append(level)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    both = F.array(
        F.struct(F.col("left").alias("word"), F.col("left_n").alias("n"), F.col("right").alias("near"), F.col("right_n").alias("near_n")),
        F.struct(F.col("right").alias("word"), F.col("right_n").alias("n"), F.col("left").alias("near"), F.col("left_n").alias("near_n")),
    )
    discard(*used)
    return pairs.distinct().select(F.explode(both).alias("x")).select("x.*")


def chain_ends(links: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form``: the last of the chain that begins with each word."""
    ends = materialise(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialise(ends.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(ends)
        ends = step
        if not step.filter("moved").limit(1).count():
            return ends.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = RATIO, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row ``word, n``."""
    words = materialise(words.select("word", "n"), "words")
    near = near_words(words, bucket_pairs).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    rows = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    is_form = F.col("form_n") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    rows = materialise(rows, "variants")
    discard(words)
    ends = chain_ends(rows.filter("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    runs = F.transform(letter_runs(F.col("text")), lambda w: F.coalesce(damaged(F.col("doc_id"), w), w))
    # the outer form: for the inner one Catalyst infers a filter on the array's size and computes the array twice
    return spelling_variants(word_counts(docs.select(F.explode_outer(runs).alias("word"))))
