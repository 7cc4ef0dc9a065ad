"""Rankers that are models: batches scored in the worker that loaded the model once, and lists ordered by sliding windows.

A pairwise model is a function of lists of queries and passages; it travels to the workers as a recipe and is made there once
a process, however many batches come. A listwise model only orders a short list; longer ones are ordered by windows from the
back to the front, so that the best passages rise through all of them, and their places become scores.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from millrace.operators.ranking import LISTWISE_PASSAGES, fallback_score

#: (queries, passages, most tokens of each pair) to scores.
PairModel = Callable[[Sequence[str], Sequence[str], Sequence[int]], np.ndarray]
#: (query, passages) to their order, best first, as indexes.
ListModel = Callable[[str, list[str]], list[int]]
BATCH = 256
WINDOW, STEP = 20, 10
FEATURES = ("bias", "coverage", "precision", "pairs")


def truncate_pair(query: list[str], passage: list[str], most: int) -> tuple[list[str], list[str]]:
    """Both sides within ``most`` tokens together: the longer one loses its end first."""
    over = max(0, len(query) + len(passage) - most)
    longer = abs(len(query) - len(passage))
    first = min(over, longer)
    rest = over - first
    cut_q, cut_p = (first, 0) if len(query) > len(passage) else (0, first)
    cut_p, cut_q = cut_p + (rest + 1) // 2, cut_q + rest // 2
    return query[: len(query) - cut_q], passage[: len(passage) - cut_p]


def tokens(text: str | None) -> list[str]:
    return re.findall("[a-z0-9]+", (text or "").lower())


def pair_features(query: str, passage: str, most: int) -> list[float]:
    """1, shares of the query's and of the passage's distinct tokens that the other has, share of the query's token pairs."""
    q, p = truncate_pair(tokens(query), tokens(passage), most)
    a, b = set(q), set(p)
    pairs, theirs = set(zip(q, q[1:])), set(zip(p, p[1:]))
    share = lambda x, y: len(x & y) / len(x) if x else 0.0
    return [1.0, share(a, b), share(b, a), share(pairs, theirs)]


def linear_model(weights: Sequence[float]) -> PairModel:
    """A logistic score of the features of a pair."""
    w = np.asarray(weights, dtype=float)

    def score(queries: Sequence[str], passages: Sequence[str], most: Sequence[int]) -> np.ndarray:
        x = np.array([pair_features(q, p, int(n)) for q, p, n in zip(queries, passages, most, strict=True)]).reshape(-1, len(w))
        return 1 / (1 + np.exp(-(x @ w)))

    return score


def fit_linear_model(pairs: DataFrame, rows: int = 20_000, steps: int = 400, ridge: float = 1e-3) -> list[float]:
    """Weights from rows ``query, text, max_length, label``: Newton steps on at most ``rows`` pairs, those of least hash.

    Features are computed by the tasks; a pair is four numbers and its label on the driver.
    """

    def features(frames):
        for f in frames:
            x = [pair_features(q, p, int(n)) for q, p, n in zip(f["query"], f["text"], f["max_length"], strict=True)]
            yield pd.DataFrame(np.array(x).reshape(-1, len(FEATURES)), columns=list(FEATURES)).assign(label=f["label"].to_numpy(dtype=float))

    picked = pairs.select("query", "text", "max_length", "label").filter("query IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL").orderBy(F.xxhash64("query", "text")).limit(rows)
    data = picked.mapInPandas(features, ", ".join(f"{c} double" for c in (*FEATURES, "label"))).toPandas().to_numpy()
    x, y, w = data[:, :-1], data[:, -1], np.zeros(len(FEATURES))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (p - y) / max(1, len(y)) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / max(1, len(y)) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in w]


def batch_scorer(make: Callable[[], PairModel], batch_size: int = BATCH) -> Callable[[Column, Column, Column], Column]:
    """A scorer for ``rerank``: ``make`` loads the model, once in each worker; null texts count as empty."""

    def predictor():
        model = make()

        def predict(queries: np.ndarray, passages: np.ndarray, most: np.ndarray) -> np.ndarray:
            return np.asarray(model([q or "" for q in queries], [p or "" for p in passages], [int(n) for n in most]), dtype=np.float64)

        return predict

    udf = predict_batch_udf(predictor, return_type=DoubleType(), batch_size=batch_size)
    return lambda query, passage, most: udf(query, passage, most)


def window_order(order: ListModel, query: str, passages: list[str], window: int = WINDOW, step: int = STEP) -> list[int]:
    """Places of all passages, best first: windows of the current order, each overlapping the next towards the front."""
    places = list(range(len(passages)))
    end = len(places)
    while end > 0:
        start = max(0, end - window)
        part = places[start:end]
        ranked = [i for i in dict.fromkeys(order(query, [passages[i] for i in part])) if 0 <= i < len(part)]
        # what the model forgets keeps its order behind what it names
        places[start:end] = [part[i] for i in [*ranked, *(i for i in range(len(part)) if i not in set(ranked))]]
        if start == 0:
            break
        end -= step
    return places


def rank_lists(queries: DataFrame, passages: DataFrame, make: Callable[[], ListModel], window: int = WINDOW, step: int = STEP, most: int = LISTWISE_PASSAGES) -> DataFrame:
    """``query_id, passage_id, pos, score, rank`` by a listwise model for queries of at most ``most`` passages with text.

    Only such short lists are gathered; a query with more is left out, as ``listwise_guard`` says.
    """
    if not 0 < step <= window:
        raise ValueError("a window must reach the next one")
    held = passages.filter(F.col("text").isNotNull() & (F.col("text") != ""))
    short = held.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most)
    lists = held.join(short, "query_id").join(queries.select("query_id", "query"), "query_id").groupBy("query_id").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("pos", "passage_id", "text"))).alias("of"))

    def ordered(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for f in frames:
            yield pd.Series([window_order(model, q or "", list(t), window, step) for q, t in zip(f[0], f[1], strict=True)])

    places = F.pandas_udf(ordered, "array<int>")("query", F.transform("of", lambda x: x["text"]))
    rows = lists.withColumn("places", places).select("query_id", "of", F.posexplode("places").alias("r", "at"))
    at = F.get("of", F.col("at"))
    return rows.select("query_id", at["passage_id"].alias("passage_id"), at["pos"].alias("pos"), fallback_score(F.col("r") + 1, F.size("of")).alias("score"), (F.col("r") + 1).alias("rank"))
