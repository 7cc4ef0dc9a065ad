"""Spelling variants against a brute-force version."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF
from millrace.llm import spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def plain(rows):
    counts = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(UPPER)
            h = zlib.crc32(f"{d}:{w}".encode())
            if d is not None and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 7
    n = {w: c for w, c in counts.items() if c >= 2}
    others, form, out = {w: [x for x in n if near(w, x)] for w in n}, {}, []
    for w in n:
        top = min(others[w], key=lambda x: (-n[x], x), default=None)
        if top and n[top] >= 10 * n[w]:
            form[w] = top
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(others[w]), n[form[w]] if w in form else None))
    return sorted(out)


def got(docs, pairs=spelling.BUCKET_PAIRS):
    runs = F.transform(spelling.letter_runs(F.col("text")), lambda w: F.coalesce(spelling.damaged(F.col("doc_id"), w), w))
    out = spelling.spelling_variants(spelling.word_counts(docs.select(F.explode_outer(runs).alias("word"))), bucket_pairs=pairs)
    return sorted(tuple(r[c] for c in COLUMNS) for r in out.collect())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(tuple(r[c] for c in COLUMNS) for r in spelling.op11(spark, SF).collect()) == want
    assert sum(r[4] > 0 for r in want) > 100 and any(r[1] for r in want)


def test_defined_cases(spark):
    chain = " ".join(["aaaaaaa"] * 2100 + ["aaaaaab"] * 210 + ["aaaaabb"] * 20 + ["aaaabbb"] * 2)
    rows = [(1, chain), (2, "SPELLING spelling Spellng spellng x1spelling2 Straße straße Strasse strasse"), (None, "spelling spellings"), (3, None), (3, ""), (4, "×÷Ààÿ×× " * 2), (4, "×÷Ààÿ×× " * 2)]
    rows += [(5, "tiebrea tiebreb " + "tiebrec " * 30 + "tiebred " * 30 + "tiebrea tiebreb"), (6, "q" * 200_000 + " " + "q" * 200_000 + " " + "q" * 200_001), (7, ("q" * 200_000 + " ") * 2), (8, "nothing\U0001d400nothing Ānothing")]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, word string, n int")
    want = plain(rows)
    by_word = {r[0]: r for r in want}
    assert by_word["aaaabbb"][1:3] == ("aaaaabb", "aaaaaaa") and by_word["tiebrea"][1] == "tiebrec"
    assert got(docs) == want
    assert got(docs.limit(0)) == []


@pytest.mark.parametrize("pairs", [0, 3, 50])
def test_crowded_buckets_lose_no_link(spark, pairs):
    words = [f"{a}{b}mmmm{c}{d}" for a in "abc" for b in "ab" for c in "xyz" for d in "xy"] + [f"{a}mmmm{c}{d}" for a in "abcd" for c in "xyz" for d in "xyz"]
    words += ["mm", "m", "n", "mn", "mmmmmmmm", "mmmmmmmmm", "mmmmmmmmmm"]
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    want = sorted((a, b) for a in words for b in words if near(a, b))
    assert sorted((r.word, r.near) for r in spelling.near_words(table, pairs).collect()) == want
