"""Near-duplicate classes by ProbMinHash.

A document is a weighted set of five-word shingles, weight 1 + ln(count). Every shingle sends arrivals of a Poisson
process with its weight as the rate to random places of the signature, each place keeping its first visitor; a shingle
stops as soon as its next arrival is later than the last place's first one. Two signatures agree in a place with
probability J_P, the probability Jaccard similarity (Jaccard's, where weights are equal).

1. Equal texts become one node. Bands of the signature give buckets of candidate nodes.
2. In every bucket all nodes are compared with its first node only (never all pairs): first by signature, then, from
   ``estimate`` up, exactly by J_P over the texts. Links of at least ``threshold`` form components.
3. Buckets that still hold several components are compared across components in blocks of bounded size: signatures
   tell which members have a partner at all, and those are verified inside their block, by an upper bound of J_P
   and, where that passes, by J_P. Only links leave the block, so no candidate is left out and no pairs are emitted.
4. Components over all links give the class: the smallest doc_id of its documents.

Bands miss a pair at the threshold with probability (1 - 0.8^5)^30, about 7e-6.

Defined cases: null and empty texts are classes of their own, never linked; texts without words link only to equal
texts; texts of fewer than five words are one shingle; repeated rows share a class; a class without any non-null
doc_id has class_id null; an empty table gives no rows. Extra columns are ignored, or kept by ``deduplicate``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm._common import byte_slices, discard, materialise, table, worker_memory

SHINGLE = 5
PLACES = 150
ROWS_A_BAND = 5
BANDS = PLACES // ROWS_A_BAND
THRESHOLD = 0.8
#: Six standard deviations below the threshold: pairs under it by signature are not verified.
ESTIMATE = 0.6
#: Members of a bucket that are compared in one block.
BLOCK = 512
GROUP = "bh long, n long, c long, blk int, i int, j int"
GROUP_COLUMNS = ["bh", "n", "c", "blk", "i", "j"]
_WORD = re.compile(r"\w+")
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


#: Text bytes signed at once, and words whose hashes a task remembers (about 150 bytes each).
SLICE_BYTES = 1 << 20
REMEMBERED_WORDS = 150_000


class WordHashes(dict):
    """Word to 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > REMEMBERED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def weighted_shingles(texts: list[str], memory: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) over distinct shingles, ordered by document and shingle."""
    words = [_WORD.findall(t.lower()) for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter(map(memory.__getitem__, chain.from_iterable(words)), _U, int(counts.sum()))
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.repeat(np.cumsum(counts) - counts, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    doc = np.repeat(np.arange(len(words)), n)
    size = np.minimum(counts, SHINGLE)[doc]
    s = size.astype(_U)
    for k in range(SHINGLE):
        part = h[np.minimum(first + k, max(0, len(h) - 1))] if len(h) else np.zeros(0, _U)
        s = np.where(k < size, _mix(s * _U(0x9E3779B97F4A7C15) + part), s)
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(s)))
    return doc[at], s[at], 1.0 + np.log(tf)


def signatures(texts: list[str], memory: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Signatures as uint32 [texts, PLACES] and which texts have one."""
    doc, s, w = weighted_shingles(texts, memory)
    best = np.full(len(texts) * PLACES, np.inf)
    who = np.zeros(len(texts) * PLACES, np.uint32)
    has = np.bincount(doc, minlength=len(texts)) > 0
    t, rounds = np.zeros(len(s)), 0
    while len(s):
        u = _mix(s + _U((rounds * 2 + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        t = t - np.log(((u >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)) / w
        new = np.append(True, doc[1:] != doc[:-1])  # documents stay in order: the latest place of each, once
        latest = best.reshape(-1, PLACES)[doc[new]].max(axis=1)
        keep = t < latest[np.cumsum(new) - 1]
        doc, s, w, t, u = doc[keep], s[keep], w[keep], t[keep], u[keep]
        place = doc * PLACES + (_mix(u + _U(0x632BE59BD9B4E019)) % _U(PLACES)).astype(np.int64)
        np.minimum.at(best, place, t)
        won = best[place] == t
        who[place[won]] = (s[won] >> _U(32)).astype(np.uint32)
        rounds += 1
    return who.reshape(-1, PLACES), has


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets (elements ascending, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][ia], b[1][ib]
    # elements of one side only have an infinite or zero ratio: their whole weight counts for every shared element
    more_a, more_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    r = x / y
    order = np.argsort(r, kind="stable")
    x, y, r = x[order], y[order], r[order]
    below = np.searchsorted(r, r, side="left")
    sx, sy = np.append(0.0, np.cumsum(x)), np.append(0.0, np.cumsum(y))
    return float((1.0 / ((sx[-1] - sx[below] + more_a) / x + (sy[below] + more_b) / y)).sum())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_memory()
    memory = WordHashes()
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in byte_slices(texts, SLICE_BYTES):
            who, has = signatures(texts.slice(lo, hi - lo).to_pylist(), memory)
            sig = pa.array([w.tobytes() if ok else None for w, ok in zip(who, has, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("ck").slice(lo, hi - lo), batch.column("doc").slice(lo, hi - lo), sig], ["ck", "doc", "sig"])


def _content(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _agreement(a: pd.Series, b: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(a), np.uint32).reshape(-1, PLACES)
    y = np.frombuffer(b"".join(b), np.uint32).reshape(-1, PLACES)
    return (x == y).mean(axis=1)


def _estimated(least: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.loc[_agreement(f["sig_a"], f["sig_b"]) >= least, ["a", "b"]]

    return run


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory()
        memory, last, seen = WordHashes(), None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("text_a"), batch.column("text_b")
            keep = []
            for i in range(len(a)):
                if a[i] != last:
                    last, seen = a[i], weighted_shingles([ta[i].as_py()], memory)[1:]
                keep.append(similarity(seen, weighted_shingles([tb[i].as_py()], memory)[1:]) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _runs(per_group, columns: list[str]):
    """Applies ``per_group`` to runs of equal (bucket, block, block), as the sorted partition brings them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_memory()
        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            if not len(f):
                continue
            key = f[["bh", "i", "j"]].to_numpy()
            cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            found = [x for lo, hi in zip(cut[:-1], cut[1:], strict=True) if len(x := per_group(f.iloc[lo:hi]))]
            rest = f.iloc[cut[-1] :]
            if found:
                yield pd.concat(found)[columns]
        if rest is not None and len(x := per_group(rest)):
            yield x[columns]

    return run


def _sides(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    i, j, blk = f["i"].iloc[0], f["j"].iloc[0], f["blk"].to_numpy()
    return np.flatnonzero(blk == i), np.flatnonzero(blk == j), bool(i == j)


def _active(least: float):
    """Rows of a group that have a partner of another component, by the signature's estimate.

    A pair counts in the first band that it shares only.
    """

    def group(f: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(f)
        n, c = f["n"].to_numpy(), f["c"].to_numpy()
        sig = np.frombuffer(b"".join(f["sig"]), np.uint32).reshape(-1, PLACES)
        live, band = np.zeros(len(f), bool), f["band"].iloc[0]
        for x in left:
            y = right[(c[right] != c[x]) & ((n[right] > n[x]) if same else True)]
            same_place = sig[y] == sig[x]
            y = y[(same_place.mean(axis=1) >= least) & (same_place.reshape(-1, BANDS, ROWS_A_BAND).all(axis=2).argmax(axis=1) == band)]
            live[y], live[x] = True, live[x] or len(y) > 0
        return f[live]

    return group


def bounded_similarity(a: tuple[np.ndarray, np.ndarray], doc: np.ndarray, s: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Upper bounds of J_P of one set with n others at once; exact where shared elements weigh the same on both sides."""
    at = np.minimum(np.searchsorted(a[0], s), len(a[0]) - 1)
    hit = a[0][at] == s
    d, x, y = doc[hit], a[1][at[hit]], w[hit]
    ia, ib = np.bincount(d, x, n), np.bincount(d, y, n)
    only_a, only_b = a[1].sum() - ia, np.bincount(doc, w, n) - ib
    return np.bincount(d, 1.0 / (only_a[d] / x + only_b[d] / y + np.maximum(ia[d] / x, ib[d] / y)), n)


def _links_across(threshold: float):
    """Links between components in a group of rows with texts: a bound first, then J_P itself."""
    memory = WordHashes()

    def group(f: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(f)
        n, c, texts = f["n"].to_numpy(), f["c"].to_numpy(), f["text"].tolist()
        doc, s, w = weighted_shingles(texts, memory)
        start = np.searchsorted(doc, np.arange(len(texts) + 1))
        own = lambda k: (s[start[k] : start[k + 1]], w[start[k] : start[k + 1]])
        parent, out = {}, []

        def head(k):
            while parent.get(k, k) != k:
                k = parent[k]
            return k

        for x in left:
            if start[x] == start[x + 1]:
                continue
            high = bounded_similarity(own(x), doc, s, w, len(texts)) >= threshold - 1e-9
            for y in right[high[right] & (c[right] != c[x])]:
                if (not same or n[y] > n[x]) and head(c[x]) != head(c[y]) and similarity(own(x), own(y)) >= threshold:
                    parent[head(c[x])] = head(c[y])
                    out.append((n[x], n[y]))
        return pd.DataFrame(out, columns=["a", "b"])

    return group


def components(edges: DataFrame, a: str = "a", b: str = "b", jumps: int = 2) -> DataFrame:
    """``n, c``: connected components of an edge table, c the name of one node of each.

    Every round gives each node its smallest neighbour's name, follows names a few steps and keeps only the edges
    between different names; it ends when none is left. Everything stays distributed; each round is written out.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = materialise(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while edges.limit(1).count():
        old = [edges, labels]
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = near = materialise(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "names")
        for _ in range(jumps):
            far = to.select(F.col("u").alias("p"), F.col("p").alias("q"))
            to = to.join(far, "p", "left").select("u", F.coalesce("q", "p").alias("p"))
        to = materialise(to, "names")
        labels = to.select(F.col("u").alias("n"), F.col("p").alias("c")) if labels is None else labels.join(to.withColumnRenamed("u", "c"), "c", "left").select("n", F.coalesce("p", "c").alias("c"))
        labels = materialise(labels, "labels")
        edges = edges.join(to, "u").select(F.col("p").alias("x"), F.col("v").alias("u")).join(to, "u").select("x", F.col("p").alias("y")).filter("x <> y")
        edges = materialise(edges.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        discard(near, to, *old)
    return labels if labels is not None else edges.select(F.col("u").alias("n"), F.col("v").alias("c"))


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """``ck, class_id, class_ck``: for every distinct non-empty text its class and the content key of its first document."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").filter(F.octet_length("text") > 0)
    signed = base.withColumn("ck", _content("text")).select("ck", "doc", "text").mapInArrow(_sign, "ck binary, doc long, sig binary")
    nodes = signed.groupBy("ck").agg(F.min("doc").alias("doc"), F.first("sig").alias("sig")).withColumn("n", F.monotonically_increasing_id())
    nodes = materialise(nodes, "nodes")

    band = lambda k: F.xxhash64(k, F.substring("sig", k * (4 * ROWS_A_BAND) + 1, F.lit(4 * ROWS_A_BAND)))
    bands = nodes.filter("sig IS NOT NULL").select("n", F.posexplode_outer(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("band", "bh"))
    buckets = bands.groupBy("bh").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count(F.lit(1)).alias("size")).filter("first < last")
    members = materialise(bands.join(buckets.select("bh", "first", "size"), "bh"), "members")

    sigs = nodes.select("n", "sig")

    def compared(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sigs.select(F.col("n").alias("b"), F.col("sig").alias("sig_b")), "b").join(sigs.select(F.col("n").alias("a"), F.col("sig").alias("sig_a")), "a")
        return pairs.mapInPandas(_estimated(ESTIMATE), "a long, b long")

    def texts_of(some: DataFrame) -> DataFrame:
        needed = some.join(nodes.select("n", "doc", "ck"), "n")
        rows = docs.select(F.col("doc_id").cast("long").alias("_d"), "text").withColumn("_k", _content("text"))
        texts = rows.join(needed, F.col("_d").eqNullSafe(F.col("doc")) & (F.col("_k") == F.col("ck"))).select("n", "text").dropDuplicates(["n"])
        return materialise(texts, "texts")

    first = materialise(compared(members.filter("n <> first").select(F.col("first").alias("a"), F.col("n").alias("b")).distinct()), "pairs")
    texts = texts_of(first.select(F.col("a").alias("n")).union(first.select(F.col("b").alias("n"))).distinct())
    full = first.join(texts.select(F.col("n").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("n").alias("a"), F.col("text").alias("text_a")), "a")
    links = materialise(full.mapInArrow(_verified(threshold), "a long, b long"), "links")
    parts = components(links)
    discard(first, texts)

    named = members.join(parts, "n", "left").select("bh", "band", "size", "n", F.coalesce("c", "n").alias("c"))
    mixed = named.groupBy("bh").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x < y").select("bh")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rest = named.join(mixed, "bh", "left_semi").withColumn("blk", F.pmod(F.xxhash64("n"), blocks).cast("int"))
    rest = rest.withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1))).select("bh", "band", "n", "c", "blk", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(groups: DataFrame) -> DataFrame:
        return groups.repartition(width, "bh", "i", "j").sortWithinPartitions("bh", "i", "j")

    live = dealt(rest.join(sigs, "n")).mapInPandas(_runs(_active(ESTIMATE), GROUP_COLUMNS), GROUP)
    live = materialise(live, "live")
    if live.limit(1).count():
        live_texts = texts_of(live.select("n").distinct())
        groups = dealt(live.join(live_texts, "n"))
        more = materialise(groups.mapInPandas(_runs(_links_across(threshold), ["a", "b"]), "a long, b long").distinct(), "links")
        parts = components(links.unionByName(more))
        discard(more, live_texts)
    discard(members, links, live)

    owned = nodes.select("n", "ck", "doc").join(parts, "n", "left").withColumn("c", F.coalesce("c", "n"))
    heads = owned.groupBy("c").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "ck")).alias("h"))
    return owned.join(heads, "c").select("ck", F.col("h.doc").alias("class_id"), F.col("h.ck").alias("class_ck"))


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id``: one row per document."""
    classes = _classes(docs, threshold)
    rows = docs.select("doc_id", F.when(F.octet_length("text") > 0, _content("text")).alias("ck"))
    return rows.join(classes, "ck", "left").select("doc_id", F.when(F.col("ck").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).cast("long").alias("class_id"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, that of the smallest doc_id, with all its columns; null and empty texts all stay."""
    heads = _classes(docs, threshold).select(F.col("class_id").alias("_h"), F.col("class_ck").alias("_hk")).distinct()
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_d"), F.when(F.octet_length("text") > 0, _content("text")).alias("_k"))
    kept = rows.filter("_k IS NOT NULL").join(heads, F.col("_d").eqNullSafe(F.col("_h")) & (F.col("_k") == F.col("_hk")))
    once = F.row_number().over(Window.partitionBy(F.coalesce("_d", F.lit(0)), F.isnull("_d"), "_k").orderBy(F.lit(0)))
    kept = kept.withColumn("_o", once).filter("_o = 1")
    return kept.select("_row.*").unionByName(rows.filter("_k IS NULL").select("_row.*"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
