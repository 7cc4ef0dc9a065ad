"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per (source, language, topic) cell in one grouped aggregation. Cell weights are raked until the
weighted token shares meet the target marginals of all three dimensions, then scaled to inclusion probabilities that
meet a token budget: cells whose probability would pass one are held there while the others are raked on. A category
whose target needs more tokens than it has is wanted whole, and what it lacks goes to the others of its dimension in
proportion to their targets, so rare categories never lower the budget. Where whole categories of one dimension
contradict another dimension's targets, the budget is met and the targets as nearly as the rounds get. Documents
are drawn by a hash of doc_id and text, so a draw repeats exactly and never depends on partitioning.

Topics are the clusters of a spherical k-means over hashed word frequencies (square roots, so that a frequent word does
not drown the others) less their language's mean, so that topics don't repeat languages. Every document with words
counts: the first job writes its vector, and means, starts and rounds are jobs over all vectors. These are rounded to steps,
so that their sums and products are exact and no centre depends on partitioning. Every document goes to its nearest centre.
Give ``topic_col`` where the table has its own. Tokens are white-space separated words.

Cells are few and raked on the driver up to a checked number; beyond it the same cap
cycles, with the same sweeps, tolerance and final scale, run as grouped joins.

Defined cases: null source or language is a category of its own; null and empty texts have no tokens, the topic -1 and
stay with probability 1; a target for a category without tokens is dropped and the rest rescaled; a category without a
target is left out, and only where the other categories have fewer tokens than the budget is it lowered, to all of
theirs; repeated rows share their fate; an empty table gives no rows. Extra columns are ignored or kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from millrace.llm._common import discard, hinted, materialise, table, worker_memory

DIMS = ("source", "lang", "topic")
#: Topics, and the hashed places of a text's words.
TOPICS = 8
PLACES = 256
#: Steps of one in vectors (16 bits hold them) and in centres: a product of both has less than 53 bits.
UNIT = 1 << 14
FINE = 1 << 24
#: Vectors that a task works on at once, languages whose sums and words whose places it holds.
BLOCK = 2048
HELD_LANGS = 1024
HELD_WORDS = 1 << 16
#: Exponents that temper the observed shares into targets.
TEMPER = {"source": 0.8, "lang": 0.9, "topic": 0.95}
#: Share of all tokens to keep; less only where the categories with a target have less.
BUDGET = 0.9
#: Times that capped cells enter the raking again.
CAPS = 12
ROUNDS = 60
TOLERANCE = 1e-6
#: Sweeps end as well where the worst miss no longer falls by this share: the targets contradict each other.
STALLED = 1e-4
#: Cells up to which raking happens on the driver and cells are broadcast.
DRIVER_CELLS = 200_000
#: Categories of a dimension up to which their factors are broadcast in distributed raking.
FEW_CATEGORIES = 10_000
_MEASURED = StructType([StructField("tokens", LongType()), StructField("terms", BinaryType())])
_WORD = re.compile(r"[^\W\d_]{3,}")


def term_vector(text: str, places: dict[str, int] | None = None) -> np.ndarray:
    """Square roots of hashed word counts, of length one; all zero for a text without words. ``places`` remembers words."""
    places = {} if places is None else places
    found = []
    for word in _WORD.findall(text.lower()):
        place = places.get(word)
        if place is None:
            if len(places) >= HELD_WORDS:
                places.clear()
            place = places[word] = zlib.crc32(word.encode()) % PLACES
        found.append(place)
    v = np.sqrt(np.bincount(np.array(found, np.int64), minlength=PLACES))
    return v / max(1e-12, float(np.sqrt(v @ v)))


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in steps; rows of zeros stay."""
    return np.rint(x / np.maximum(1e-12, np.sqrt((x * x).sum(axis=1, keepdims=True))) * UNIT).astype("<i2")


def totals(x: np.ndarray) -> np.ndarray:
    """Sums of the vectors with any word, and how many they are."""
    x = x[x.any(axis=1)]
    return np.append(x.sum(axis=0, dtype=np.int64), len(x))


def mean_of(sums: np.ndarray) -> np.ndarray:
    return sums[:PLACES] / (UNIT * max(1, int(sums[PLACES])))


def apart(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Directions of vectors from their languages' means."""
    return units(x / UNIT - means)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x / UNIT @ centres.T).argmax(axis=1)


def farthest(x: np.ndarray, centres: np.ndarray) -> tuple[float, bytes]:
    """The vector whose nearest centre is farthest, behind its closeness; of equal ones the first by bytes."""
    near = (x / UNIT @ centres.T).max(axis=1) if len(centres) else np.zeros(len(x))
    return float(near.min()), min(v.tobytes() for v in x[near == near.min()])


def member_totals(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Sums and numbers of the vectors nearest to each centre."""
    near = nearest(x, centres)
    ones = (near == np.arange(len(centres))[:, None]).astype(float)
    return np.rint(np.hstack([ones @ x, ones.sum(axis=1, keepdims=True)])).astype(np.int64)


def k_means(far: Callable[[np.ndarray], bytes], members: Callable[[np.ndarray], np.ndarray], k: int, rounds: int = 30) -> np.ndarray:
    """Centres of length one; starts from rows that are far from the ones before, so equal input gives equal centres."""
    centres = np.zeros((0, PLACES))
    while len(centres) < k:
        centres = np.vstack([centres, np.frombuffer(far(centres), "<i2") / UNIT])
    for _ in range(rounds):
        sums = members(centres)
        directions = sums[:, :PLACES] / np.maximum(1e-12, np.sqrt((sums[:, :PLACES].astype(float) ** 2).sum(axis=1, keepdims=True)))
        new = np.where(sums[:, PLACES:] > 0, np.rint(directions * FINE) / FINE, centres)
        if np.allclose(new, centres):
            break
        centres = new
    return centres


class Topics:
    """Centres of topics and the mean term vector of each language (under None: of all), of vectors at hand."""

    def __init__(self, langs: list[str | None], x: np.ndarray, k: int):
        x = units(x)
        self.means = {None: mean_of(totals(x))}
        for lang in {v for v in langs if v is not None}:
            self.means[lang] = mean_of(totals(x[[v == lang for v in langs]]))
        words = x.any(axis=1)
        x = apart(x, np.stack([self.means[v] for v in langs]))[words] if len(x) else x
        self.centres = k_means(lambda c: farthest(x, c)[1], lambda c: member_totals(x, c), min(k, len(x))) if len(x) else np.eye(1, PLACES)

    def nearest(self, text: str, lang: str | None) -> int:
        mean = self.means.get(lang, self.means[None])
        return int(nearest(apart(units(term_vector(text)[None]), mean[None]), self.centres)[0])


def _blocks(*columns: pd.Series) -> Iterator[tuple[np.ndarray, ...]]:
    """Vectors of binary columns, a bounded number of rows at a time; the first has steps, the others numbers."""
    for at in range(0, len(columns[0]), BLOCK):
        parts = [b"".join(c.iloc[at : at + BLOCK]) for c in columns]
        yield tuple(np.frombuffer(p, "<f8" if n else "<i2").reshape(-1, PLACES) for n, p in enumerate(parts))


def language_means(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(``_lang, mean`` of each language with words, sums of all vectors) of ``lang, terms``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_memory()
        held: dict[str | None, np.ndarray] = {}
        for f in frames:
            for lang, part in f.groupby("lang", dropna=False)["terms"]:
                lang = None if pd.isna(lang) else lang
                for (x,) in _blocks(part):
                    held[lang] = held.get(lang, 0) + totals(x)
                if len(held) >= HELD_LANGS:
                    yield pd.DataFrame({"lang": list(held), "sums": list(held.values())})
                    held = {}
        yield pd.DataFrame({"lang": pd.Series(list(held), dtype=object), "sums": pd.Series(list(held.values()), dtype=object)})

    @F.pandas_udf("binary")
    def mean(sums: pd.Series) -> pd.Series:
        return pd.Series([mean_of(s).astype("<f8").tobytes() for s in sums], dtype=object)

    parts = rows.select("lang", "terms").filter("terms IS NOT NULL").mapInPandas(run, "lang string, sums array<long>")
    each = parts.select("lang", F.posexplode("sums").alias("place", "s")).groupBy("lang", "place").agg(F.sum("s").alias("s"))
    whole = each.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "s"))), lambda p: p["s"]).alias("sums"))
    means = materialise(whole.select(F.col("lang").alias("_lang"), "sums", mean("sums").alias("mean")), "means")
    sums = np.zeros(PLACES + 1, np.int64)
    for r in means.select(F.posexplode("sums").alias("place", "s")).groupBy("place").agg(F.sum("s").alias("s")).collect():
        sums[r.place] = r.s
    return means.filter(F.get("sums", F.lit(PLACES)) > 0).select("_lang", "mean"), sums


def fit_topics(rows: DataFrame, k: int = TOPICS) -> tuple[DataFrame, Column, np.ndarray]:
    """(``rows`` with the ``mean`` of their language, the number of their topic, centres), fitted on all ``lang, terms``.

    Each start and each round is a job over all vectors that brings back one vector or the sums of each topic.
    """
    means, sums = language_means(rows)
    near = hinted(means, means.count(), FEW_CATEGORIES)
    rows = rows.join(near, F.col("lang") == F.col("_lang"), "left").withColumn("mean", F.coalesce("mean", F.lit(mean_of(sums).astype("<f8").tobytes()))).drop("_lang")

    def directions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_memory()
        for f in frames:
            for x, means in _blocks(f["terms"], f["mean"]):
                yield pd.DataFrame({"v": pd.Series([v.tobytes() for v in apart(x, means)[x.any(axis=1)]], dtype=object)})

    vectors = materialise(rows.filter("terms IS NOT NULL").select("terms", "mean").mapInPandas(directions, "v binary"), "vectors")

    def far(centres: np.ndarray) -> bytes:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = [farthest(x, centres) for f in frames for (x,) in _blocks(f["v"])]
            if found:
                yield pd.DataFrame([min(found)], columns=["near", "v"])

        return bytes(vectors.mapInPandas(run, "near double, v binary").agg(F.min(F.struct("near", "v")).alias("x")).first().x.v)

    def members(centres: np.ndarray) -> np.ndarray:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = np.zeros((len(centres), PLACES + 1), np.int64)
            for f in frames:
                for (x,) in _blocks(f["v"]):
                    found += member_totals(x, centres)
            yield pd.DataFrame({"topic": range(len(found)), "sums": list(found)})

        parts = vectors.mapInPandas(run, "topic int, sums array<long>").select("topic", F.posexplode("sums").alias("place", "s"))
        out = np.zeros((len(centres), PLACES + 1), np.int64)
        for r in parts.groupBy("topic", "place").agg(F.sum("s").alias("s")).collect():
            out[r.topic, r.place] = r.s
        return out

    centres = k_means(far, members, min(k, int(sums[PLACES]))) if sums[PLACES] else np.eye(1, PLACES)
    discard(vectors)

    @F.pandas_udf("int")
    def topic(terms: pd.Series, means: pd.Series) -> pd.Series:
        worker_memory()
        none = bytes(2 * PLACES)
        found = [nearest(apart(x, m), centres) for x, m in _blocks(terms.map(lambda t: t or none), means)]
        return pd.Series(np.concatenate(found) if found else [], dtype="int32")

    return rows, topic("terms", "mean"), centres


def measured(docs: DataFrame, topic_col: str | None = None, columns: list[str] | None = None, seed: int = 17) -> DataFrame:
    """``_row`` (all columns, or those asked for), ``source, lang, topic, tokens`` and the document's uniform draw ``u``.

    Texts are read once here: what is measured of them is written, and the topics are fitted on that.
    """
    row = F.struct(*[F.col(c) for c in columns or docs.columns]).alias("_row")
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))
    u = (F.shiftrightunsigned(key, 11).cast("double") + 0.5) / float(1 << 53)
    names = [row, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")]
    if topic_col:
        tokens = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
        rows = docs.select(*names, F.col(topic_col).cast("string").alias("topic"), tokens.alias("tokens"), u.alias("u"))
        return materialise(rows, "measures")

    @F.pandas_udf(_MEASURED)
    def measure(texts: pd.Series) -> pd.DataFrame:
        places = worker_memory("mixing", dict)
        tokens = [len((t or "").split()) for t in texts]
        terms = [units(term_vector(t, places)[None]).tobytes() if n else None for t, n in zip(texts, tokens, strict=True)]
        return pd.DataFrame({"tokens": pd.Series(tokens, dtype="int64"), "terms": pd.Series(terms, dtype=object)})

    rows = docs.select(*names, measure("text").alias("_m"), u.alias("u"))
    rows = materialise(rows.select("_row", "source", "lang", "_m.tokens", "_m.terms", "u"), "measures")
    rows, topic, _ = fit_topics(rows)
    return rows.select("_row", "source", "lang", F.when(F.col("tokens") > 0, topic).otherwise(-1).cast("string").alias("topic"), "tokens", "u")


def cell_tokens(rows: DataFrame) -> DataFrame:
    return rows.filter("tokens > 0").groupBy(*DIMS).agg(F.sum("tokens").alias("t"))


def tempered(tokens: dict, power: float) -> dict:
    """Target shares: observed shares to a power, rescaled."""
    raw = {k: float(v) ** power for k, v in tokens.items()}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()}


def _scale(t: np.ndarray, w: np.ndarray, budget: float) -> float:
    """The factor with sum(t * min(1, factor * w)) = budget * sum(t)."""
    order = np.argsort(-w)
    t, w = t[order], w[order]
    full = np.concatenate([[0.0], np.cumsum(t)])
    tail = np.concatenate([np.cumsum((t * w)[::-1])[::-1], [0.0]])
    goal = budget * full[-1]
    for k in range(len(w)):
        factor = (goal - full[k]) / tail[k] if tail[k] > 0 else np.inf
        if factor * w[k] <= 1 + 1e-12:
            return max(0.0, factor)
    return np.inf


def _attainable(t: np.ndarray, goal: np.ndarray, budget: float) -> np.ndarray:
    """Shares of the kept tokens nearest to the goals that categories of t tokens can fill, when budget * sum(t) are kept."""
    w = np.divide(goal, t, out=np.zeros_like(goal), where=t > 0)
    filled = t * np.minimum(1.0, np.where(w > 0, _scale(t, w, budget), 0.0) * w)
    return filled / filled.sum()


def rake(cells: pd.DataFrame, targets: dict[str, dict], budget: float = BUDGET, rounds: int = ROUNDS) -> np.ndarray:
    """Inclusion probabilities of cells (source, lang, topic, t): raked to the targets, then to the budget."""
    p = np.zeros(len(cells))
    codes, goals = [], []
    for d in DIMS:
        keys, code = np.unique(cells[d].map(repr), return_inverse=True)
        by = {repr(k): v for k, v in targets[d].items()}
        codes.append(code)
        goals.append(np.array([by.get(k, 0.0) for k in keys], float))
    wanted = np.all([goal[code] > 0 for code, goal in zip(codes, goals, strict=True)], axis=0)
    if not wanted.any():
        return p
    t = cells["t"].to_numpy(float)
    budget = min(1.0, budget * t.sum() / t[wanted].sum())
    t, codes = t[wanted], [code[wanted] for code in codes]
    goals = [_attainable(np.bincount(code, t, len(goal)), goal, budget) for code, goal in zip(codes, goals, strict=True)]
    w = np.ones(len(t))
    for cycle in range(CAPS):
        last = np.inf
        for sweep in range(rounds):
            worst = 0.0
            for code, goal in zip(codes, goals, strict=True):
                share = np.bincount(code, t * w, len(goal)) / (t * w).sum()
                factor = np.divide(goal, share, out=np.zeros_like(goal), where=share > 0)
                w = w * factor[code]
                worst = max(worst, float(np.abs(goal - share).max()))
            if worst < TOLERANCE or worst > (1 - STALLED) * last:
                break
            last = worst
        if cycle and not sweep:  # the caps left the targets met
            break
        # capped cells enter the next raking at their cap
        w = np.minimum(1.0, _scale(t, w, budget) * w)
    p[wanted] = np.minimum(1.0, _scale(t, w, budget) * w)
    return p


def rake_distributed(cells: DataFrame, targets: dict[str, DataFrame], budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """The same for cell tables of any size: targets are tables (dimension, goal). Adds ``p``.

    Within a cycle cells stay as they are: each dimension has a table of its categories' goals and factors so far.
    """
    ok = F.lit(True)
    known = cells
    for d in DIMS:
        goal = targets[d].filter("goal > 0").select(F.col(d).alias(f"_{d}"), F.lit(True).alias(f"_has_{d}"))
        known, ok = known.join(goal, F.col(d).eqNullSafe(F.col(f"_{d}")), "left"), ok & F.col(f"_has_{d}").isNotNull()
    known = materialise(known.select(*DIMS, "t", ok.alias("wanted")), "cells")
    sums = known.agg(F.sum("t").alias("all"), F.sum(F.when(F.col("wanted"), F.col("t"))).alias("wanted")).first()
    if not sums.wanted:
        return known.select(*DIMS, "t", F.lit(0.0).alias("p"))
    budget = min(1.0, budget * sums["all"] / sums.wanted)
    w = known.filter("wanted").select(*DIMS, "t", F.lit(1.0).alias("w"))
    targets = {d: _attainable_distributed(w.groupBy(d).agg(F.sum("t").alias("t")), targets[d], budget) for d in DIMS}
    spark, few = cells.sparkSession, {d: targets[d].count() <= FEW_CATEGORIES for d in DIMS}
    for cycle in range(CAPS):
        w = materialise(w, "cells")
        total = w.agg(F.sum(F.col("t") * F.col("w"))).first()[0]
        factors = {d: targets[d].select(d, "goal", F.lit(1.0).alias("f")) for d in DIMS}
        factors = {d: F.broadcast(f) if few[d] else f for d, f in factors.items()}
        last = float("inf")
        for sweep in range(rounds):
            worst = 0.0
            for d in DIMS:
                rest = _weighted(w, {o: f for o, f in factors.items() if o != d})
                sums = rest.groupBy(F.col(d).alias("_k")).agg((F.sum(F.col("t") * F.col("w")) / total).alias("_s"))
                both = factors[d].join(sums, F.col(d).eqNullSafe(F.col("_k")))
                off = F.abs(F.col("goal") - F.col("f") * F.col("_s")).alias("off")
                now = both.select(d, "goal", (F.col("goal") / F.col("_s")).alias("f"), off)
                if few[d]:
                    rows = now.collect()
                    worst = max(worst, *(r.off for r in rows))
                    factors[d] = F.broadcast(spark.createDataFrame(rows, now.schema).coalesce(1))
                else:
                    factors[d] = materialise(now, "factors")
                    worst = max(worst, factors[d].agg(F.max("off")).first()[0])
            if worst < TOLERANCE or worst > (1 - STALLED) * last:
                break
            last = worst
        w = materialise(_weighted(w, factors), "cells")
        if cycle and not sweep:
            break
        w = w.withColumn("w", F.least(F.lit(1.0), F.col("w") * _scale_distributed(w, budget)))
    w = materialise(w, "cells")
    w = w.withColumn("w", F.least(F.lit(1.0), F.col("w") * _scale_distributed(w, budget)))
    return w.withColumnRenamed("w", "p").unionByName(known.filter("NOT wanted").select(*DIMS, "t", F.lit(0.0).alias("p")))


def _weighted(w: DataFrame, factors: dict[str, DataFrame]) -> DataFrame:
    """Cells with their weight times the factors of their categories."""
    for d, table_ in factors.items():
        by = table_.select(F.col(d).alias("_g"), F.col("f").alias("_f"))
        w = w.join(by, F.col(d).eqNullSafe(F.col("_g"))).withColumn("w", F.col("w") * F.col("_f")).drop("_g", "_f")
    return w


def _attainable_distributed(have: DataFrame, goals: DataFrame, budget: float) -> DataFrame:
    """As _attainable, of tables (dimension, t) and (dimension, goal)."""
    d = have.columns[0]
    goals = goals.select(F.col(d).alias("_g"), "goal")
    rows = materialise(have.join(goals, F.col(d).eqNullSafe(F.col("_g"))).select(d, "t", (F.col("goal") / F.col("t")).alias("w")), "goals")
    filled = rows.select(d, (F.col("t") * F.least(F.lit(1.0), F.col("w") * _scale_distributed(rows, budget))).alias("goal"))
    return materialise(filled.withColumn("goal", F.col("goal") / filled.agg(F.sum("goal")).first()[0]), "goals")


def _scale_distributed(w: DataFrame, budget: float) -> float:
    """As _scale: the factor grows until no further row passes one."""
    goal, factor = None, 0.0
    while True:
        full = F.col("w") * factor >= 1
        sums = w.agg(F.sum("t").alias("t"), F.sum(F.when(full, F.col("t"))).alias("full"), F.sum(F.when(~full, F.col("t") * F.col("w"))).alias("tail")).first()
        goal = budget * sums.t if goal is None else goal
        above = (goal - (sums.full or 0)) / sums.tail if sums.tail else 0.0
        if above <= factor * (1 + 1e-12):
            return factor
        factor = above


def inclusion(cells: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET) -> DataFrame:
    """``source, lang, topic, p`` of every cell."""
    spark = cells.sparkSession
    cells = materialise(cells, "cells")
    n = cells.count()
    marginals = {d: cells.groupBy(d).agg(F.sum("t").alias("t")) for d in DIMS}
    if n <= DRIVER_CELLS:
        known = cells.toPandas().sort_values(list(DIMS), na_position="first", ignore_index=True)
        known = known.astype({d: object for d in DIMS}).where(known.notna(), None)
        goals = targets or {d: tempered(known.groupby(d, dropna=False)["t"].sum().rename(lambda k: None if pd.isna(k) else k).to_dict(), TEMPER[d]) for d in DIMS}
        known["p"] = rake(known, goals, budget)
        columns = [pa.array([None if pd.isna(x) else x for x in known[d]], pa.string()) for d in DIMS]
        # from Arrow: rows of Python objects would pass through Python workers of another kind, which stay on the executors
        return F.broadcast(spark.createDataFrame(pa.table([*columns, pa.array(known["p"], pa.float64())], [*DIMS, "p"])))
    goal_tables = {}
    for d in DIMS:
        raw = marginals[d].select(d, F.pow("t", TEMPER[d]).alias("goal")) if targets is None else spark.createDataFrame(list(targets[d].items()), f"{d} string, goal double")
        total = raw.agg(F.sum("goal")).first()[0]
        goal_tables[d] = materialise(raw.withColumn("goal", F.col("goal") / total), "goals")
    return rake_distributed(cells, goal_tables, budget).select(*DIMS, "p")


def _kept(rows: DataFrame, targets: dict[str, dict] | None, budget: float) -> DataFrame:
    p = inclusion(cell_tokens(rows), targets, budget).select(*[F.col(d).alias(f"_{d}") for d in DIMS], "p")
    out = rows.join(p, [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in DIMS], "left").withColumn("p", F.coalesce("p", F.lit(1.0)))
    return out.select("_row", *DIMS, "tokens", "p", (F.col("u") < F.col("p")).alias("kept"))


def drawn(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET, seed: int = 17, topic_col: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """``_row, source, lang, topic, tokens, p, kept`` of every document."""
    return _kept(measured(docs, topic_col, columns, seed), targets, budget)


def sample_mixture(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET) -> DataFrame:
    """The drawn documents with their columns."""
    return drawn(docs, targets, budget).filter("kept").select("_row.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drawn(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return out.select("_row.doc_id", "source", "lang", "topic", "tokens", F.round("p", 9).alias("p"), "kept")
