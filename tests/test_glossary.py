"""Glossary pages by jumps against a sequential fold."""

import random
from collections import defaultdict

import pytest

from millrace.operators import docs, glossary


def fold(lines, bundle, most):
    pages, page = [], [glossary.TOP, f"Bundle: {bundle}"]
    for line in lines:
        if len("\n".join(page)) + 1 + len(line) + 1 > most and len(page) > 3:
            pages.append("\n".join(page) + "\n")
            page = [glossary.TOP + glossary.MORE, f"Bundle: {bundle}"]
        page.append(line)
    return [*pages, "\n".join(page) + "\n"]


def entities(spark, sizes, most, seed):
    draw, rows = random.Random(seed), []
    for bundle, n in sizes:
        for i in range(n):
            # one in thirty is longer than a page, some longer than a block
            size = draw.choice([3, 8, 20, 30]) if draw.random() < 0.97 else most * draw.choice([1, 3, 40])
            rows.append((bundle, f"e{i}", f"{draw.choice('aAbB')}{'n' * size}{draw.randrange(10**6)}", draw.choice(["", "element"]), draw.choice([None, " ", "d" * 119, "d" * 121])))
    return spark.createDataFrame(rows, "bundle string, entity_id string, name string, kind string, description string"), rows


@pytest.mark.parametrize("most", [60, 150, 700])
def test_pages_equal_a_sequential_fold(spark, most):
    df, _ = entities(spark, [("a", 1), ("bb", 2), ("c" * 20, 400), ("d", 77)], most, most)
    lines = defaultdict(list)
    for r in sorted(glossary.glossary_lines(df).collect(), key=lambda r: (r.bundle, r.name_key, r.entity_id)):
        lines[r.bundle].append(r.line)
    want = sorted((b, i + 1, t) for b, ls in lines.items() for i, t in enumerate(fold(ls, b, most)))
    got = glossary.glossary_docs(df, most).collect()
    assert sorted((r.bundle, r.number, r.text) for r in got) == want
    assert {r.bundle: r.total for r in got} == {b: len(fold(ls, b, most)) for b, ls in lines.items()}


def test_names_with_one_prefix_are_packed_by_many_tasks(spark):
    df, rows = entities(spark, [("urn:long:namespace:" * 3, 5000)], 300, 9)
    pages, placed = glossary.glossary_pages(glossary.glossary_lines(df), 300)
    assert placed.select("block").distinct().count() > 20
    spans = sorted((r.start, r.next) for r in pages.collect())
    # pages follow each other without gaps to the last entry
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] >= len(rows)


def test_no_entities(spark):
    df, _ = entities(spark, [("a", 1)], 60, 1)
    assert glossary.glossary_docs(df.limit(0)).collect() == []


def test_entries_of_pages_are_not_broadcast(spark):
    df, _ = entities(spark, [("a", 300)], 150, 2)
    plan = glossary.glossary_docs(df, 150)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and ", i#" in x] and "SortMergeJoin" in plan
