"""Models as rankers: batches, pair cuts, windows, and what a passage brings along."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import rank_models, ranking


def test_pairs_are_cut_at_their_longer_side():
    q, p = list("abcdef"), list("uvwxyz12")
    for n in range(1, 16):
        a, b = rank_models.truncate_pair(q, p, n)
        want_q, want_p = q[:], p[:]
        while len(want_q) + len(want_p) > n:
            (want_q if len(want_q) > len(want_p) else want_p).pop()
        assert (a, b) == (want_q, want_p)


def pairs(spark, n=300):
    draw, words = random.Random(2), [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        q = draw.sample(words, 5)
        p = draw.sample(words, 20) if i % 2 else [*draw.sample(words, 8), *q[:4], *draw.sample(words, 8)]
        rows.append((i % 20, i, str(i), " ".join(q), " ".join(p), 128, float(i % 2 == 0)))
    return spark.createDataFrame(rows, "query_id long, pos long, passage_id string, query string, text string, max_length int, label double")


def test_scores_do_not_depend_on_batches(spark):
    df = pairs(spark).unionByName(pairs(spark, 2).withColumn("text", F.lit(None).cast("string")))
    weights = rank_models.fit_linear_model(df)
    assert weights[3] > 1
    model = rank_models.linear_model(weights)
    want = {(r.pos, r.text): float(model([r.query], [r.text or ""], [r.max_length])[0]) for r in df.collect()}
    for size in (1, 7, 1000):
        scored = df.withColumn("s", rank_models.batch_scorer(lambda: rank_models.linear_model(weights), size)(F.col("query"), F.col("text"), F.col("max_length"))).collect()
        assert {(r.pos, r.text): r.s for r in scored} == pytest.approx(want)
    right = [r for r in scored if r.text and (r.s > 0.5) == bool(r.label)]
    assert len(right) > 0.97 * 300


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    mark = str(tmp_path)

    def make():
        import tempfile

        tempfile.mkstemp(dir=mark)
        return rank_models.linear_model((0, 1, 0, 0))

    df = pairs(spark).repartition(2)
    df.select(rank_models.batch_scorer(make, 8)(F.col("query"), F.col("text"), F.col("max_length"))).collect()
    assert 1 <= len(list(tmp_path.iterdir())) <= 4


def test_windows_from_the_back(spark):
    draw = random.Random(4)

    def by_number(query, passages):
        return sorted(range(len(passages)), key=lambda i: -int(passages[i]))

    for n in (0, 1, 5, 20, 21, 50):
        values = [str(draw.randrange(1000)) for _ in range(n)]
        want = list(range(n))
        end = n
        while end > 0:  # the plain version: sort one window after another
            start = max(0, end - 6)
            want[start:end] = sorted(want[start:end], key=lambda i: -int(values[i]))
            end = end - 3 if start else 0
        got = rank_models.window_order(by_number, "", values, 6, 3)
        assert got == want and [values[i] for i in got[:3]] == sorted(values, key=lambda v: -int(v))[:3]
    # what a model forgets, repeats or invents does no harm
    assert rank_models.window_order(lambda q, p: [2, 2, 9, -1], "", ["a", "b", "c"]) == [2, 0, 1]


def test_lists_are_ranked_by_place(spark):
    rows = [(1, f"p{i}", i, str(i % 7)) for i in range(30)] + [(2, f"q{i}", i, "1") for i in range(51)] + [(3, "x", 0, ""), (4, "y", 0, None), (5, "z", 3, "9")]
    passages = spark.createDataFrame(rows, "query_id int, passage_id string, pos int, text string")
    queries = spark.createDataFrame([(i, None if i == 5 else "q") for i in range(1, 6)], "query_id int, query string")
    got = rank_models.rank_lists(queries, passages, lambda: lambda q, p: sorted(range(len(p)), key=lambda i: -int(p[i]))).collect()
    assert {r.query_id for r in got} == {1, 5} and sorted(r["rank"] for r in got if r.query_id == 1) == list(range(1, 31))
    first = sorted((r for r in got if r.query_id == 1), key=lambda r: r["rank"])
    assert [r.pos % 7 for r in first[:4]] == [6] * 4 and [r.pos for r in first[:4]] == [6, 13, 20, 27]
    assert [r.score for r in first[:2]] == [1.0, pytest.approx(1 - 1e-3 / 30)]
    with pytest.raises(ValueError):
        rank_models.rank_lists(queries, passages, lambda: None, 5, 6)


def test_passages_come_back_as_they_were(spark):
    rows = [("q", "b", 0, "red fox", {"a": 1}, [1.5], 7), ("q", "b", 1, "blue whale", None, None, 8), ("q", "c", 2, None, None, None, 9)]
    passages = spark.createDataFrame(rows, "query_id string, passage_id string, pos int, text string, meta map<string,int>, `odd.name` array<double>, rank int")
    queries = spark.createDataFrame([("q", "blue whale", "pairwise_nano", None)], "query_id string, query string, model string, max_length int")
    got = ranking.rerank_passages(queries, passages).orderBy("rank").collect()
    assert [(r.passage_id, r.pos, r["rank"], r.text, r.meta, r["odd.name"]) for r in got] == [("b", 1, 1, "blue whale", None, None), ("b", 0, 2, "red fox", {"a": 1}, [1.5])]


def test_requests_are_answered(spark):
    passages = [{"id": 1, "text": "Lyon", "meta": {"z": [1, {"y": None}], "a": "é"}, "extra": 1.50}, {"id": "two", "text": "Paris is the capital", "score": 9, "t": True}]
    good = {"query": "capital Paris", "model": "pairwise_nano", "passages": passages}
    bad = [
        {**good, "passages": []}, {**good, "passages": [{"id": 1}]}, {**good, "passages": [{"id": 1, "text": ""}]}, {**good, "passages": [{"text": "x"}]}, {**good, "model": "none"}, {**good, "max_length": 0}, {**good, "max_length": 513},
        {**good, "max_length": "x"}, {"model": "pairwise_nano", "passages": passages}, {**good, "model": "listwise_medium", "passages": passages * 26}, {**good, "passages": [7]},
    ]
    texts = [json.dumps(good), json.dumps({**good, "max_length": 512, "model": "listwise_medium"}), "nope", None, *map(json.dumps, bad)]
    got = {r.query_id: (r.status, json.loads(r.response)) for r in ranking.rerank_requests(spark.createDataFrame(list(enumerate(texts)), "query_id int, request string")).collect()}
    assert len(got) == len(texts) and all(got[i][0] == 422 and got[i][1]["detail"] for i in range(2, len(texts)))
    status, answer = got[0]
    assert status == 200 and list(answer) == ["model", "family", "max_length", "query", "results"] and (answer["family"], answer["max_length"], answer["query"]) == ("pairwise", 128, "capital Paris")
    assert answer["results"] == [{"id": "two", "text": "Paris is the capital", "t": True, "score": 1.0}, {**passages[0], "score": 0.0}]
    assert got[1][1]["family"] == "listwise" and got[1][1]["max_length"] == 512
