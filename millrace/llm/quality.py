"""Quality by hierarchical empirical Bayes.

Evidence: a logistic model over shape features of a whole text (shares of letters, capitals, digits, symbols and
bars; repetition of words and lines; lengths), fitted on every labelled row outside the held-out third. It gives each
document a probability p of being good. Features are measured and written once; each step of the fit is a job over them.

Sites: p is summed per host and per path below it by grouped aggregation. Host rates are drawn from a Beta whose
mean and strength come from the spread of the hosts (method of moments); a path's prior is its host's posterior, with a
strength that comes in the same way from the spread of paths around their hosts. So a sparse path falls back to its host and a sparse host to the global mean. A document's own odds are multiplied by the
odds of its path's posterior rate over those of the global mean, an influence bounded by ``max_shift``.

Defined cases: null texts count as empty; empty and wordless texts have p near 0 as their features say; a null host
or path is a site of its own; repeated rows count each time; without labelled rows of both kinds the model is the
prior 0.5 and everything stays; empty tables give no rows. Extra columns are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from millrace.llm._common import discard, held_out, hinted, materialise, table, worker_memory
from millrace.llm._linear import logistic_sums, newton

#: Sites up to which their posteriors are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SITES = 500_000
KEEP = 0.5
FEATURES = 18


def shape_features(text: str | None) -> np.ndarray:
    """Features of a whole text, all in small ranges."""
    t = text or ""
    raw = np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256) if t else np.zeros(256, np.int64)
    n = max(1, int(raw.sum()))
    upper, lower, digit = raw[65:91].sum(), raw[97:123].sum(), raw[48:58].sum()
    words, lines = t.split(), [x for x in t.split("\n") if x]
    k = max(1, len(words))
    kinds = len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    comma_stop = raw[44] + raw[46]
    symbols = raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum() - comma_stop
    longest = max(map(len, words), default=0)
    return np.array(
        [
            upper / max(1, upper + lower), digit / n, symbols / n, raw[124] / k, raw[33] / k, comma_stop / k, raw[128:].sum() / n, np.log1p(len(words)) / 5,
            kinds / k, again / k, len(set(lines)) / max(1, len(lines)), n / k / 10, min(longest, 200) / 50, np.log1p(len(lines)) / 3, float(len(words) == 0),
            float(len(words) < 20), (raw[35:39].sum() + raw[42]) / k, len(lines) / k,
        ]
    )


def _features(texts: pd.Series) -> np.ndarray:
    return np.stack([shape_features(t) for t in texts]) if len(texts) else np.zeros((0, FEATURES))


@F.pandas_udf(ArrayType(DoubleType()))
def features(texts: pd.Series) -> pd.Series:
    worker_memory()
    return pd.Series(list(_features(texts)), dtype=object)


def fit(rows: DataFrame, labels: DataFrame, label_col: str = "quality") -> np.ndarray | None:
    """Weights from every labelled one of ``doc_id, x`` outside the held-out third; of repeated ids one row each."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out("_id"))
    pairs = rows.select("doc_id", "x").join(known, F.col("doc_id") == F.col("_id"))
    known = materialise(pairs.groupBy("_id").agg(F.min(F.struct("y", "x")).alias("_m")).select("_m.y", "_m.x"), "labelled")
    if known.select("y").distinct().count() < 2:
        discard(known)
        return None
    n = FEATURES + 1

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            worker_memory()
            grad, h = np.zeros(n), np.zeros((n, n))
            for f in frames:
                if len(f):
                    g, c = logistic_sums(np.hstack([np.stack(f["x"].to_numpy()), np.ones((len(f), 1))]), f["y"].to_numpy(float), w)
                    grad, h = grad + g, h + c
            yield pd.DataFrame({"s": [np.concatenate([grad, h.ravel()])]})

        parts = known.mapInPandas(run, "s array<double>").select(F.posexplode("s").alias("place", "s"))
        out = np.zeros(n + n * n)
        for r in parts.groupBy("place").agg(F.sum("s").alias("s")).collect():
            out[r.place] = r.s
        return out[:n], out[n:].reshape(n, n)

    weights = newton(sums, n, l2=0.05)
    discard(known)
    return weights


def document_evidence(weights: np.ndarray | None) -> Column:
    """p of the features ``x`` by the document model alone."""
    if weights is None:
        return F.lit(0.5)
    z = reduce(lambda a, b: a + b, [F.get("x", F.lit(i)) * F.lit(float(w)) for i, w in enumerate(weights[:-1])]) + F.lit(float(weights[-1]))
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """``host, path, shift``: from rows (host, path, p) the log odds that a path's posterior adds to a document.

    Null hosts and paths group together, as groupBy does.
    """
    paths = materialise(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum(F.pow(F.col("hs") / F.col("hn"), 2) * F.col("hn")).alias("q"), F.count(F.lit(1)).alias("k")).first()
    n = total.n or 0
    mean = min(0.999, max(0.001, total.s / n)) if n else 0.5

    def strength_of(spread: float, groups: int) -> float:
        """The Beta's strength from a variance of rates, less what counting alone gives."""
        beyond = max(1e-6, spread - mean * (1 - mean) * groups / n) if n else 1e-6
        return min(1e5, max(2.0, mean * (1 - mean) / beyond - 1))

    strength = strength_of(max(0.0, total.q / n - mean * mean) if n else 0.0, total.k or 0)
    hosts = hosts.withColumn("host_rate", (F.col("hs") + strength * mean) / (F.col("hn") + strength)).select(F.col("host").alias("_h"), "host_rate")
    out = paths.join(hosts, F.col("host").eqNullSafe(F.col("_h")))
    around = out.agg(F.sum(F.pow(F.col("s") / F.col("n") - F.col("host_rate"), 2) * F.col("n")).alias("q"), F.count(F.lit(1)).alias("k")).first()
    below = strength_of((around.q or 0.0) / n if n else 0.0, around.k or 0)
    out = out.withColumn("rate", (F.col("s") + below * F.col("host_rate")) / (F.col("n") + below))
    rate = F.least(F.greatest("rate", F.lit(0.001)), F.lit(0.999))
    return out.select("host", "path", (F.log(rate / (1 - rate)) - float(np.log(mean / (1 - mean)))).alias("shift"))


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", max_shift: float = 1.0, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with all columns (or those asked for) in ``_row`` and ``p, posterior``; texts are measured once."""
    row = F.struct(*[F.col(c) for c in columns or docs.columns]).alias("_row")
    measured = docs.select(row, "doc_id", F.col(host).cast("string").alias("_host"), F.col(path).cast("string").alias("_path"), features("text").alias("x"))
    measured = materialise(measured, "evidence")
    with_p = measured.select("_row", "_host", "_path", document_evidence(fit(measured, labels)).alias("p"))
    sites = materialise(site_posteriors(with_p.select(F.col("_host").alias("host"), F.col("_path").alias("path"), "p")), "shifts")
    joined = with_p.join(hinted(sites, sites.count(), BROADCAST_SITES), F.col("_host").eqNullSafe(F.col("host")) & F.col("_path").eqNullSafe(F.col("path")), "left")
    shift = F.least(F.greatest(F.coalesce("shift", F.lit(0.0)), F.lit(-max_shift)), F.lit(max_shift))
    safe = F.least(F.greatest("p", F.lit(1e-9)), F.lit(1 - 1e-9))
    return joined.select("_row", "p", (1 / (1 + F.exp(-(F.log(safe / (1 - safe)) + shift)))).alias("posterior"))


def keep_good(docs: DataFrame, labels: DataFrame, at_least: float = KEEP) -> DataFrame:
    """The documents whose posterior reaches ``at_least``, with their columns."""
    return score(docs, labels).filter(F.col("posterior") >= at_least).select("_row.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, table(spark, sf_dir, "labels"), columns=["doc_id"])
    return scored.select("_row.doc_id", F.round("p", 6).alias("p"), F.round("posterior", 6).alias("posterior"), (F.col("posterior") >= KEEP).alias("keep"))
