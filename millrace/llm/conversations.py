"""Conversations repaired by weighted finite-state composition.

Three machines: the input acceptor reads a conversation's rows in order, the edit transducer keeps, reroles or deletes a
row or inserts one, the role grammar accepts ``(s?(ua)+)?``. They are composed lazily: only states that some cheapest
path reaches are built. Rows are read in order and insertions only cost, so states come in topological order and one pass
finds the shortest path over the weights (cost, edit initials), compared in that order. At equal cost and equal rows read
neither of two strings of initials is a prefix of the other, so appending keeps their order.

A run of rows has a weight for each pair of grammar states, and these tables multiply associatively. So a conversation
need not lie in one task: narrow rows (hashes and faults, no texts) are range-partitioned by conversation and place, every
task multiplies its run in blocks, and only the two conversations at a task's ends are finished by a second, small product.
A long conversation is shared by many tasks; memory is bounded by its string of edits. Texts are shuffled once, to write
the repaired rows: a task streams each conversation's edits ahead of its rows. The digest of a conversation is
sequential by definition and follows this stream with constant memory.

Faults, the first of a row counting: blank (nothing but ASCII space), duplicate (role and text seen earlier), truncated
(its last character outside ASCII space is not ``.``, ``!`` or ``?``).

Defined cases: a null role or text is one space; a null turn comes first; rows of one turn come by role, then by the
SHA-256 of their text, so equal rows are adjacent; an empty role has no initial and can't be kept; rows without a conv_id
form one conversation; a conversation without rows has zeros and empty strings; an empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import discard, materialise, table, worker_memory

#: The role grammar as an automaton by role initials; where it begins, and where it may end.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
START, FINAL = 0, (0, 3)
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
#: Rows multiplied one by one before their table joins the product.
BLOCK = 256
SLICE_ROWS, SLICE_BYTES = 4096, 4 << 20
SPACE = " \t\n\x0b\x0c\r"

Weight = tuple[int, str]
Symbol = tuple[str, bool, bool]  # role initial, must go, truncated


def arcs(symbol: Symbol) -> list[tuple[str, int, str]]:
    """Edits of one row: (initial, cost, output); an output of '' leaves the grammar where it is."""
    initial, must_go, truncated = symbol
    out = [("D", DELETE, "")]
    if not must_go:
        more = TRUNCATED * truncated
        out += [("R", REROLE + more, x) for x in ROLES]
        out += [("K", KEEP + more, initial)] if initial else []
    return out


def _relax(frontier: dict[int, Weight], state: int, weight: Weight) -> bool:
    if state in frontier and frontier[state] <= weight:
        return False
    frontier[state] = weight
    return True


def _inserted(frontier: dict[int, Weight]) -> dict[int, Weight]:
    """The states reached by inserting rows."""
    todo = list(frontier)
    while todo:
        state = todo.pop()
        cost, labels = frontier[state]
        for x in ROLES:
            to = GRAMMAR[state].get(x)
            if to is not None and _relax(frontier, to, (cost + INSERT, labels + "I")):
                todo.append(to)
    return frontier


def shortest(symbols: Iterable[Symbol], start: int = START) -> dict[int, Weight]:
    """For each grammar state at the end the least (cost, edits) of all ways through the rows."""
    frontier = _inserted({start: (0, "")})
    for symbol in symbols:
        after: dict[int, Weight] = {}
        for state, (cost, labels) in frontier.items():
            for label, more, output in arcs(symbol):
                to = GRAMMAR[state].get(output) if output else state
                if to is not None:
                    _relax(after, to, (cost + more, labels + label))
        frontier = _inserted(after)
    return frontier


def multiply(left: dict[int, dict[int, Weight]], right: dict[int, dict[int, Weight]]) -> dict[int, dict[int, Weight]]:
    """The table of two runs after each other."""
    out: dict[int, dict[int, Weight]] = {}
    for start, ends in left.items():
        row: dict[int, Weight] = {}
        for middle, (cost, labels) in ends.items():
            for end, (more, rest) in right.get(middle, {}).items():
                _relax(row, end, (cost + more, labels + rest))
        out[start] = row
    return out


class Run:
    """Rows of one conversation in one task: their table in blocks, multiplied like a binary counter, and their role changes."""

    def __init__(self, starts: Iterable[int]):
        self.starts = tuple(starts)
        self.block: list[Symbol] = []
        self.tables: list[tuple[int, dict]] = []
        self.first = self.last = None
        self.illegal = 0

    def add(self, symbol: Symbol) -> None:
        self.block.append(symbol)
        if self.last is None:
            self.first = symbol[0]
        else:
            self.illegal += self.last + symbol[0] not in LEGAL
        self.last = symbol[0]
        if len(self.block) == BLOCK:
            self._close()

    def _close(self) -> None:
        starts = self.starts if not self.tables else GRAMMAR
        size, made = 1, {s: shortest(self.block, s) for s in starts}
        while self.tables and self.tables[-1][0] == size:
            made = multiply(self.tables.pop()[1], made)
            size *= 2
        self.tables.append((size, made))
        self.block = []

    def table(self) -> dict[int, dict[int, Weight]]:
        if self.block or not self.tables:
            self._close()
        out = self.tables[-1][1]
        for _, left in reversed(self.tables[:-1]):
            out = multiply(left, out)
        return out


def best(ends: dict[int, Weight]) -> Weight:
    return min(ends[s] for s in FINAL if s in ends)


def _steps(rows: DataFrame) -> DataFrame:
    """Narrow rows with their faults: equal rows of one turn are one row with ``copies``."""
    tail = F.rtrim(F.col("text"), F.lit(SPACE))
    ended = F.substring(tail, -1, 1).isin(".", "!", "?")
    narrow = rows.select("conv_id", "turn", "role", _digest().alias("text_id"), (tail == "").alias("blank"), (~ended).alias("open_end"))
    keys = ["conv_id", "turn", "role", "text_id"]
    steps = narrow.groupBy(*keys).agg(F.first("blank").alias("blank"), F.first("open_end").alias("open_end"), F.count(F.lit(1)).alias("copies"))
    steps = materialise(steps, "steps")
    # the earliest turn of a role and text, a null turn being the earliest of all
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = steps.filter("NOT blank").groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("text_id").alias("_t")).agg(F.min(place).alias("seen"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("text_id") == F.col("_t"))
    out = steps.join(seen, same, "left")
    repeated = F.coalesce(~F.col("turn").eqNullSafe(F.col("seen.turn")) & F.col("seen").isNotNull(), F.lit(False))
    out = materialise(out.select(*keys, "blank", "open_end", "copies", repeated.alias("repeated")), "faults")
    discard(steps)
    return out


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


TABLE = "array<struct<start: int, end: int, cost: bigint, labels: string>>"
RUNS = f"conv_id bigint, part int, whole boolean, first string, last string, illegal bigint, cost bigint, audit string, ways {TABLE}"
_WAYS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("labels", pa.string())]))
_RUNS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("whole", pa.bool_()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("ways", _WAYS)])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of a task in order; the first and the last may go on in other tasks."""
    from pyspark import TaskContext

    worker_memory()
    part, run, conv, n = TaskContext.get().partitionId(), None, None, 0
    out: list[tuple] = []

    def open_row() -> tuple:
        ways = [{"start": s, "end": e, "cost": c, "labels": x} for s, ends in run.table().items() for e, (c, x) in ends.items()]
        return (conv, part, False, run.first, run.last, run.illegal, None, None, ways)

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _RUNS, strict=True)], schema=_RUNS)
        out.clear()
        return made

    for rows in batches:
        columns = (rows.column(c).to_pylist() for c in ("conv_id", "role", "blank", "repeated", "open_end", "copies"))
        for c, role, blank, repeated, open_end, copies in zip(*columns, strict=True):
            if run is None or c != conv:
                if n == 1:
                    out.append(open_row())
                elif n > 1:
                    cost, audit = best(run.table()[START])
                    out.append((conv, part, True, run.first, run.last, run.illegal, cost, audit, []))
                conv, run, n = c, Run(GRAMMAR if n == 0 else (START,)), n + 1
            initial = role[:1]
            run.add((initial, blank or repeated, not blank and not repeated and open_end))
            for _ in range(copies - 1):
                run.add((initial, True, False))
        if len(out) >= SLICE_ROWS:
            yield batch()
    if run is not None:
        out.append(open_row())
    if out:
        yield batch()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one conversation, gathered in order, become one."""
    names = ["conv_id", "illegal", "cost", "audit"]
    for rows in batches:
        out = []
        for conv, parts in zip(rows.column("conv_id").to_pylist(), rows.column("parts").to_pylist(), strict=True):
            ends: dict[int, Weight] = {START: (0, "")}
            illegal, last = 0, None
            for p in parts:
                ways: dict[int, dict[int, Weight]] = {}
                for w in p["ways"]:
                    ways.setdefault(w["start"], {})[w["end"]] = (w["cost"], w["labels"])
                ends = multiply({START: ends}, ways)[START]
                illegal += p["illegal"] + (last is not None and last + p["first"] not in LEGAL)
                last = p["last"]
            out.append((conv, illegal, *best(ends)))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def _place() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text_id").asc()]


def _audits(steps: DataFrame) -> DataFrame:
    """``conv_id, illegal, cost, audit`` of every conversation with rows."""
    n = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    conv = F.col("conv_id").asc_nulls_first()
    ordered = steps.repartitionByRange(n, conv, *_place()).sortWithinPartitions(conv, *_place())
    runs = materialise(ordered.select("conv_id", "role", "blank", "repeated", "open_end", "copies").mapInArrow(_runs, RUNS), "runs")
    parts = F.array_sort(F.collect_list(F.struct("part", "first", "last", "illegal", "ways")))
    joined = runs.filter("NOT whole").groupBy("conv_id").agg(parts.alias("parts")).mapInArrow(_joined, "conv_id bigint, illegal bigint, cost bigint, audit string")
    return runs.filter("whole").select("conv_id", "illegal", "cost", "audit").unionByName(joined)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's edits, then its rows: the repaired rows."""
    worker_memory()
    names, types = ["conv_id", "seq", "turn", "role", "text"], (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    out: list[tuple] = []
    conv, audit, at, state, seq = None, "", 0, START, 0

    def put(turn: int | None, initial: str, role: str, text: str) -> None:
        nonlocal state, seq
        out.append((conv, seq, turn, role, text))
        state, seq = GRAMMAR[state][initial], seq + 1

    def wanted() -> str:
        return next(x for x in ROLES if x in GRAMMAR[state])

    def insertions() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            at += 1
            put(None, wanted(), ROLES[wanted()], "")

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
        out.clear()
        return made

    for rows in batches:
        size = 0
        for c, edits, turn, role, text in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "audit", "turn", "role", "text")), strict=True):
            if edits is not None:
                insertions()
                conv, audit, at, state, seq = c, edits, 0, START, 0
                continue
            insertions()
            edit = audit[at]
            at += 1
            if edit == "K":
                put(turn, role[:1], role, text)
            elif edit == "R":
                put(turn, wanted(), ROLES[wanted()], text)
            size += len(text)
            if size >= SLICE_BYTES:
                size = 0
                if out:
                    yield batch()
        if len(out) >= SLICE_ROWS or size:
            if out:
                yield batch()
    insertions()
    if out:
        yield batch()


def _repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    ahead = audits.select("conv_id", F.lit(0).alias("behind"), "audit", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(b"").alias("text_id"))
    theirs = rows.select("conv_id", F.lit(1).alias("behind"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text", _digest().alias("text_id"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ahead.unionByName(theirs).repartition(n, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "behind", *_place())
    return ordered.select("conv_id", "audit", "turn", "role", "text").mapInArrow(_edited, "conv_id bigint, seq bigint, turn bigint, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of ``role:text`` lines of conversations that come one after another."""
    conv, state, names = None, None, ["conv_id", "repaired_sha256"]
    for rows in batches:
        out = []
        for c, seq, role, text in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "seq", "role", "text")), strict=True):
            if seq == 0:
                if state is not None:
                    out.append((conv, state.hexdigest()))
                conv, state = c, hashlib.sha256()
            state.update((f"\n{role}:{text}" if seq else f"{role}:{text}").encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()], pa.string())], names)


def _clean(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def repaired_rows(rows: DataFrame) -> DataFrame:
    """``conv_id, seq, turn, role, text``: the repaired conversations, each in order in one partition; inserted rows have no turn."""
    rows = _clean(rows)
    return _repaired(rows, _audits(_steps(rows)))


def repair_report(rows: DataFrame) -> DataFrame:
    """A row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    rows = _clean(rows)
    steps = _steps(rows)
    audits = materialise(_audits(steps), "audits")
    known = ~F.col("blank")
    counts = steps.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).cast("long").alias("blank"),
        F.sum(F.when(known, F.col("copies") - F.when(F.col("repeated"), 0).otherwise(1)).otherwise(0)).cast("long").alias("duplicate"),
        F.sum(F.when(known & ~F.col("repeated") & F.col("open_end"), 1).otherwise(0)).cast("long").alias("truncated"),
    )
    digests = _repaired(rows, audits).mapInArrow(_digests, "conv_id bigint, repaired_sha256 string")
    parts = counts.unionByName(audits, allowMissingColumns=True).unionByName(digests, allowMissingColumns=True)
    return parts.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in parts.columns if c != "conv_id"])


def with_every(conversations: DataFrame, report: DataFrame) -> DataFrame:
    """The report with a row for each conv_id of ``conversations``, zeros and empty strings where nothing is left of it."""
    asked = conversations.select(F.col("conv_id").cast("long").alias("conv_id"))
    all_of = report.unionByName(asked, allowMissingColumns=True).groupBy("conv_id").agg(*[F.max(c).alias(c) for c in report.columns if c != "conv_id"])
    default = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return all_of.select("conv_id", *[F.coalesce(c, F.lit(default.get(c, 0)).cast("string" if c in default else "long")).alias(c) for c in report.columns if c != "conv_id"])


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with one fault in four, by the checksum of ``conv_id:turn``: dropped, emptied, without ends, repeated, a user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("k"))
    new = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("k <> 0").select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), new.alias("text"), F.explode(copies)).drop("col")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return with_every(conversations, repair_report(damaged(conversations)))
