"""Toxicity by weak supervision.

Voters: words (present or not) and patterns (a word prefix occurring at least a given number of times). They are mined
from a bounded sample of labelled rows outside the held-out third by grouped counts, keeping those that favour toxic
texts most by a likelihood-ratio statistic.

Generative label model: each voter fires with one rate on toxic and another on clean texts. The rates start at the
labelled counts and are re-estimated by expectation maximisation over the sample, labelled and unlabelled rows alike
(a known label enters as one more, strong vote). Correlations between voters are estimated as well: of voters that
nearly always fire together only the best is taken, and among the rest a voter's evidence is divided by one plus the
strong correlations of its residuals, given the posterior, with those of others. So ten prefixes of one word do not
count ten times.

A logistic model over the voters' outputs, their counts and their density is then trained on the posterior labels, and
scores every whole text. Labels, language, source and doc_id never enter a score.

Defined cases: null and empty texts get the score of a text on which no voter fires; repeated rows get equal scores;
without labelled rows of both kinds, or without voters, every score is the prior; an empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import held_out, materialise, table
from millrace.llm._linear import fit_logistic, predict_logistic

#: The most labelled and the most unlabelled rows of the sample, the first by a hash of doc_id.
FIT_ROWS = 12_000
UNLABELLED_ROWS = 4_000
#: Voters mined, and the most kept of them once near copies of better voters are dropped.
MINED = 600
VOTERS = 200
SAME_VOTE = 0.85
#: Residual correlations from here on are shared out.
STRONG = 0.6
PREFIXES = (4, 5, 6, 7)
TIMES = (2, 3, 4)
MIN_TOXIC = 5
#: How sure a known label is.
LABEL_TRUST = 0.98
PREDICT = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def text_features(words: list[str]) -> set[str]:
    """All votes a text can give: its words, and '4+^pref' style patterns."""
    out = set(words)
    for k in PREFIXES:
        for p, n in Counter(w[:k] for w in words if len(w) > k).items():
            for t in TIMES:
                if n >= t:
                    out.add(f"{t}+^{p}")
    return out


class Voters:
    """The chosen voters; gives the vote vector of a text."""

    def __init__(self, names: list[str]):
        self.names = names
        self.words = {v: i for i, v in enumerate(names) if "+^" not in v}
        self.prefixes: dict[int, dict[str, list[tuple[int, int]]]] = defaultdict(dict)
        for i, v in enumerate(names):
            if "+^" in v:
                times, p = v.split("+^", 1)
                self.prefixes[len(p)].setdefault(p, []).append((int(times), i))
        self.heads = {p[:4] for by in self.prefixes.values() for p in by}

    def votes(self, text: str | None) -> tuple[list[int], int]:
        """Voters that fire, and the number of words."""
        words = _WORD.findall((text or "").lower())
        fired = [self.words[w] for w in set(words) & self.words.keys()]
        if self.heads:
            near = [w for w in words if w[:4] in self.heads]
            for k, by in self.prefixes.items():
                for p, n in Counter(w[:k] for w in near if len(w) > k).items():
                    fired += [i for t, i in by.get(p, ()) if n >= t]
        return fired, len(words)

    def matrix(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        votes, lens = np.zeros((len(texts), len(self.names)), np.float32), np.zeros(len(texts))
        for r, t in enumerate(texts):
            fired, lens[r] = self.votes(t)
            votes[r, fired] = 1
        return votes, lens


def classifier_inputs(votes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Votes, then how many fire, whether any does, and their density."""
    n = votes.sum(axis=1)
    return np.hstack([votes, np.stack([np.log1p(n), n > 0, n / (lens + 20)], axis=1)])


def mine_voters(sample: DataFrame, voters: int = MINED) -> list[str]:
    """The features that favour toxic texts most, by grouped counts over the labelled sample (y, text)."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean = Counter(), Counter()
        for f in frames:
            for y, t in zip(f["y"], f["text"], strict=True):
                (toxic if y == 1 else clean).update(text_features(_WORD.findall((t or "").lower())))
        rows = [(v, toxic[v], clean[v]) for v in {*toxic, *clean}]
        yield pd.DataFrame(rows, columns=["v", "a", "b"]).astype({"a": "int64", "b": "int64"})

    known = sample.filter("y IS NOT NULL")
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return []
    sums = known.select("y", "text").mapInPandas(count, "v string, a long, b long").groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ra, rb = F.col("a") / n1, (F.col("b") + 0.5) / (n0 + 1)
    gain = F.col("a") * F.log((F.col("a") + 0.5) / (n1 + 1) / rb)
    lift = (F.col("a") >= MIN_TOXIC) & (ra > 8 * rb)
    return [r.v for r in sums.filter(lift).withColumn("g", gain).orderBy(F.desc("g"), "v").limit(voters).collect()]


def distinct_voters(votes: np.ndarray, most: int = VOTERS, same: float = SAME_VOTE) -> list[int]:
    """Columns, best first, that do not nearly repeat a better one."""
    sd = votes.std(axis=0) + 1e-9
    z = (votes - votes.mean(axis=0)) / sd
    rho = z.T @ z / max(1, len(z))
    kept: list[int] = []
    for j in range(votes.shape[1]):
        if len(kept) < most and (rho[j, kept] < same).all():
            kept.append(j)
    return kept


def label_model(votes: np.ndarray, y: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, dict]:
    """Posterior P(toxic) of each row; y holds 0, 1 or NaN. Returns the model's parameters as well."""
    known = ~np.isnan(y)
    prior = float(np.clip(y[known].mean(), 0.01, 0.5))
    q = np.where(known, np.where(y == 1, LABEL_TRUST, 1 - LABEL_TRUST), prior)
    share = np.ones(votes.shape[1])
    for _ in range(rounds):
        a = (votes.T @ q + 0.5) / (q.sum() + 1)
        b = (votes.T @ (1 - q) + 0.5) / ((1 - q).sum() + 1)
        # correlation of what is left of the votes once the class is known
        rest = votes - np.outer(q, a) - np.outer(1 - q, b)
        sd = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        rho = np.clip((rest.T @ rest) / len(rest) / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(rho, 0)
        rho[rho < STRONG] = 0
        share = 1 / (1 + rho.sum(axis=1))
        on, off = np.log(a / b), np.log((1 - a) / (1 - b))
        odds = np.log(prior / (1 - prior)) + (votes * (on - off) + off) @ share
        odds += np.where(known, np.where(y == 1, 1, -1) * np.log(LABEL_TRUST / (1 - LABEL_TRUST)), 0)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved, q = np.abs(new - q).max(), new
        prior = float(np.clip(q.mean(), 0.01, 0.5))
        if moved < 1e-4:
            break
    return q, {"prior": prior, "on_toxic": a, "on_clean": b, "share": share}


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = FIT_ROWS, unlabelled: int = UNLABELLED_ROWS) -> dict:
    """Voters and weights. All that is brought to the driver is the sample's vote matrix."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1))
    usable = known.filter(~held_out("_id"))
    picked = usable.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    some = docs.select("doc_id").join(known.select("_id").distinct(), F.col("doc_id") == F.col("_id"), "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled)
    picked = picked.unionByName(some.select(F.col("doc_id").alias("_id"), F.lit(None).cast("int").alias("y")))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).dropDuplicates(["_id"]).select("y", "text")
    sample = materialise(sample, "sample")
    names = mine_voters(sample)
    if not names:
        return {"names": [], "weights": None, "prior": 0.1}
    voters = Voters(names)

    def cast(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            votes, lens = voters.matrix(f["text"].tolist())
            yield pd.DataFrame({"y": f["y"].astype("float64"), "n": lens, "v": [np.flatnonzero(r).tolist() for r in votes]})

    got = sample.mapInPandas(cast, "y double, n double, v array<int>").toPandas()
    votes = np.zeros((len(got), len(names)), np.float32)
    for r, v in enumerate(got["v"]):
        votes[r, np.asarray(v, int)] = 1
    kept = distinct_voters(votes)
    names, votes = [names[j] for j in kept], votes[:, kept]
    q, model = label_model(votes, got["y"].to_numpy(float))
    weights = fit_logistic(classifier_inputs(votes, got["n"].to_numpy()), q, l2=0.05)
    return {"names": names, "weights": weights, "prior": model["prior"]}


def score_texts(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, score`` of every whole text."""
    names, weights, prior = model["names"], model["weights"], model["prior"]

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        if weights is None or not len(texts):
            return pd.Series(np.full(len(texts), prior))
        return pd.Series(predict_logistic(weights, classifier_inputs(*Voters(names).matrix(texts.tolist()))))

    return docs.select("doc_id", toxic("text").alias("score"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_texts(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= PREDICT, 1).otherwise(0).alias("predicted"))
