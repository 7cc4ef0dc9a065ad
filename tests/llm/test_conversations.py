"""Conversation repair against an exhaustive search."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from conftest import SF
from millrace.llm import conversations

COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
ACCEPTED, PREFIX = re.compile(r"(s?(ua)+)?\Z"), re.compile(r"(s?(ua)*u?)\Z")
EMPTY = hashlib.sha256(b"").hexdigest()


def search(rows, faults):
    """Cheapest edits, then least string, by best-first search over edit strings."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(rows) and ACCEPTED.match(roles):
            return cost, audit, lines
        if (i, roles[-1:]) in done:
            continue
        done.add((i, roles[-1:]))
        steps = [(2, "I", i, x, ((name, ""),)) for x, name in (("u", "user"), ("a", "assistant"))]
        if i < len(rows):
            _, role, text = rows[i]
            late = faults[i] == "truncated"
            steps.append((3, "D", i + 1, "", ()))
            if faults[i] not in ("blank", "duplicate"):
                steps += [(2 + late, "R", i + 1, x, ((name, text),)) for x, name in (("u", "user"), ("a", "assistant"))]
                steps += [(late + 0, "K", i + 1, role[0], ((role, text),))] if role else []
        for more, label, at, x, line in steps:
            if PREFIX.match(roles + x):
                heapq.heappush(heap, (cost + more, audit + label, at, roles + x, lines + line))


def plain(table, damage):
    conv = {}
    for c, *row in table:
        conv.setdefault(c, []).append(row)
    out = []
    for c, given in conv.items():
        rows = []
        for turn, role, text in given:
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            rows += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        if not rows:
            out.append((c, 0, 0, 0, 0, 0, 0, "", EMPTY))
            continue
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in rows:
            said = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, lines = search(rows, faults)
        out.append((c, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_whole_table(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(conversations.op12(spark, SF)) == plain(table, True)


@pytest.fixture
def odd(spark):
    draw, rows = random.Random(5), []
    for c in [None, 1, 2, 3, 4, 5, 6, 7, 8] + [9] * 25 + list(range(10, 40)):
        for _ in range(draw.randrange(1, 9)):
            rows.append((c, draw.randrange(300) if c == 9 else draw.choice([None, *range(8)]), draw.choice(["user", "user", "assistant", "system", "tool", None, "", " user"]), draw.choice(["x.", "y", "Z! \n", "", None, "\t ", "w?", " "])))
    rows += [(50, None, None, None)] * 4 + [(51, 3, "user", "z" * 300_000), (51, 4, "assistant", "z" * 300_000 + ".")]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, part int")


@pytest.mark.parametrize(("parts", "block"), [(1, 256), (8, 4), (60, 1)])
def test_long_conversations_are_shared_by_tasks(spark, odd, parts, block, monkeypatch):
    rows, df = odd
    monkeypatch.setattr(conversations, "BLOCK", block)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert rows_of(conversations.with_every(df, conversations.repair_report(df))) == plain(rows, False)
        assert rows_of(conversations.with_every(df, conversations.repair_report(conversations.damaged(df)))) == plain(rows, True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_blocks_multiply_to_the_whole():
    draw = random.Random(3)
    for _ in range(100):
        symbols = [(draw.choice("suax"), draw.random() < 0.3, draw.random() < 0.3) for _ in range(draw.randrange(9))]
        symbols = [(i, gone, cut and not gone) for i, gone, cut in symbols]
        cut = draw.randrange(len(symbols) + 1)
        left, right = ({s: conversations.shortest(part, s) for s in conversations.GRAMMAR} for part in (symbols[:cut], symbols[cut:]))
        assert conversations.multiply(left, right) == {s: conversations.shortest(symbols, s) for s in conversations.GRAMMAR}


def test_repaired_rows_are_legal(spark, odd):
    by_conv = {}
    for r in conversations.repaired_rows(odd[1]).orderBy("conv_id", "seq").collect():
        by_conv.setdefault(r.conv_id, []).append(r)
    for rows in by_conv.values():
        assert [r.seq for r in rows] == list(range(len(rows))) and ACCEPTED.match("".join(r.role[0] for r in rows))
    assert max(len(r.text) for r in by_conv[51]) == 300_001


def test_empty_table(spark, odd):
    none = odd[1].limit(0)
    assert conversations.with_every(none, conversations.repair_report(conversations.damaged(none))).collect() == []
    assert conversations.repaired_rows(none).collect() == []
