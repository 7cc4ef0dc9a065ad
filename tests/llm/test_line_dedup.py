"""Lines that many documents share, against SQL and a plain version."""

import hashlib
from collections import defaultdict

from conftest import SF, duck, rows_of
from millrace.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, h1 string, _keep int"


def plain(rows):
    held = defaultdict(set)
    key = lambda line: line.strip(SPACE).translate(UPPER)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(d)
    least = lambda d: (d is not None, d or 0)
    keeper = {k: max(ds, key=least) for k, ds in held.items() if len(ds) >= 5}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(docs, **more):
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, **more))
    return sorted(((r.doc_id, r._n_lines, r._n_dropped, hashlib.sha256(r._kept.encode()).hexdigest()) for r in out.collect()), key=repr)


def test_against_sql(spark):
    assert rows_of(line_dedup.op13(spark, SF)) == duck(line_dedup.OP13_SQL)


def test_defined_cases(spark):
    shared, umlauts, short = "this very line stands in a good many documents", "Ü" * 39 + "X", "x" * 39
    rows = [(i, f"head {i}\n  {shared.upper() if i % 2 else shared}\t\n{umlauts}\n{short}\ntail") for i in range(7)]
    rows += [(6, f"{shared}\n{shared}\nmore"), (6, f"{shared}\n{shared}\nmore"), (None, f"{shared}\n\n{shared}"), (None, None), (7, None), (8, ""), (9, "\n\n"), (10, umlauts + "\n" + "ü" * 40), (11, " \x0b" + umlauts + "\x0c")]
    rows += [(20 + i, f"only four documents of forty characters hold it {'-' * 9}\n\n") for i in range(4)]
    rows += [(30, "\n".join(f"a very long text of lines that nobody else has, {i}" for i in range(50_000)) + "\n" + shared), (31, "y" * 3_000_000)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    want = plain(rows)
    assert sum(r[2] for r in want) > 15
    for hot in (0, 3, 10_000):
        assert got(docs, hot_rows=hot) == want
    assert line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).columns[:4] == docs.columns
    assert got(docs.limit(0)) == []


def test_bitmaps_are_runs_of_kept_lines(spark):
    line = "a line of more than forty characters, shared by all"
    docs = spark.createDataFrame([(i, f"{line}\na\nb\n{line}\n{line}\nc") for i in range(5)], "doc_id long, text string")
    out = {r.doc_id: (r.n_dropped, [(x.first, x.length) for x in r.keep]) for r in line_dedup.keep_bitmaps(docs).collect()}
    assert out == {i: (3, [(1, 2), (5, -1)]) for i in range(4)}


def test_the_stream_reuses_its_ranges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = line_dedup.dropped_lines(docs)[0]._jdf.queryExecution().executedPlan().toString()
    streamed = plan[plan.index("Window") :]
    assert streamed.count("rangepartitioning") == 1 and "hashpartitioning" not in streamed and streamed.count("Sort [") == 1
