"""Markdown chunking: header scan, choice of a header level, header-aware sections, bounded pieces.

Everything up to the choice of a level is array work inside a document's own row: no shuffle. Sections and oversize
pieces come from small vectorised helpers that pass whole texts once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.batches import byte_slices

MARK = "\u0001"
#: Headers as the scan sees them: the title may follow on a later line. Only \n ends a line; \s is Unicode.
HEADER = r"(?dmU)^(#{1,6})\s+(.+?)\s*$"
MAX_LEVEL = 6
SOFT_CHUNKS = 4000
SEPARATORS = ("\n\n", "\n", " ", "")


def check_parameters(max_header_level: int = 0, max_chars: int = 6000, piece: int = 2500, overlap: int = 200, prefix: str = "PATH: ", min_chars: int = 900, target: int | None = None) -> None:
    """Raises on limits a job must not pass."""
    rules = [
        (0 <= max_header_level <= MAX_LEVEL, "max_header_level is 0 to 6"), (max_chars >= 200, "max_chars is at least 200"), (piece >= 100, "a piece has at least 100 characters"),
        (0 <= overlap <= piece, "the overlap is between 0 and the piece"), (1 <= len(prefix) <= 50, "the prefix has 1 to 50 characters"), (min_chars >= 0, "min_chars is not negative"),
        (target is None or target >= 200, "the target is at least 200"),
    ]
    for ok, message in rules:
        if not ok:
            raise ValueError(message)


def parameter_rejects(requests: DataFrame) -> DataFrame:
    """The same limits for parameters given per row (max_header_level, max_chars, piece, overlap): adds ``error``."""
    c = F.col
    error = (
        F.when(~c("max_header_level").between(0, MAX_LEVEL), "max_header_level").when(c("max_chars") < 200, "max_chars").when(c("piece") < 100, "piece")
        .when((c("overlap") < 0) | (c("overlap") > c("piece")), "overlap")
    )
    return requests.withColumn("error", error)


def with_headers(docs: DataFrame) -> DataFrame:
    """Adds ``_h`` (headers) and ``_len``."""
    clean = docs.withColumn("_parts", F.split(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), MARK, "\u0002"), HEADER, MARK + "$0"), MARK))
    sized = clean.withColumn("_lens", F.transform("_parts", F.length))
    # running offsets without a window: one fold over the part lengths
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"] + n)).alias("all"))
    ends = sized.withColumn("_ends", F.aggregate("_lens", zero, step)["all"])
    full = lambda p, g: F.regexp_extract(p, r"(?dsU)^(#{1,6})\s+([^\n]+?)\s*(?:\n.*)?$", g)
    heads = F.transform(
        F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))),
        lambda p, i: F.struct(F.element_at("_ends", (i + 1).cast("int")).alias("start"), F.length(full(p, 1)).alias("level"), full(p, 2).alias("title")),
    )
    return ends.withColumn("_h", heads).withColumn("_len", F.length(F.coalesce("text", F.lit("")))).drop("_parts", "_lens", "_ends")


def md_headers(docs: DataFrame) -> DataFrame:
    """``doc_id, start, level, title`` of every header."""
    rows = with_headers(docs).select("doc_id", F.explode_outer("_h").alias("h")).filter("h IS NOT NULL")
    return rows.select("doc_id", "h.start", "h.level", "h.title")


def _sizes(level: int) -> Column:
    """Section sizes at a level: split at headers of that level or above; text before the first is a section."""
    starts = F.transform(F.filter("_h", lambda h: h["level"] <= level), lambda h: h["start"])
    all_starts = F.when(F.size(starts) == 0, F.array(F.lit(0))).when(F.element_at(starts, 1) == 0, starts).otherwise(F.concat(F.array(F.lit(0)), starts))
    return all_starts


def with_level_sizes(docs: DataFrame) -> DataFrame:
    """Adds ``_levels``: array of (level, sizes) for the levels up to the deepest header."""
    df = with_headers(docs).withColumn("_deep", F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform("_h", lambda h: h["level"])), F.lit(1))))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), _sizes(k).alias("starts")) for k in range(1, MAX_LEVEL + 1)])
    df = df.withColumn("_ls", F.filter(levels, lambda x: x["level"] <= F.col("_deep")))
    sizes = lambda s: F.zip_with(s, F.concat(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.col("_len"))), lambda a, b: b - a)
    return df.withColumn("_levels", F.transform("_ls", lambda x: F.struct(x["level"].alias("level"), sizes(x["starts"]).alias("sizes")))).drop("_ls")


def header_section_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, level, section, size``."""
    rows = with_level_sizes(docs).select("doc_id", F.explode_outer("_levels").alias("l"))
    return rows.select("doc_id", "l.level", F.posexplode_outer("l.sizes").alias("section", "size"))


def default_target(min_chars: int, max_chars: int) -> int:
    return int(max(min_chars * 1.5, min(max_chars * 0.65, max_chars - 500)))


def level_scores(docs: DataFrame, max_chars: int = 6000, min_chars: int = 900, target: int | None = None) -> DataFrame:
    """Adds ``_scores``: array of (score, level); lower is better."""
    goal = target or default_target(min_chars, max_chars)
    scale = float(max(1, goal))
    df = with_level_sizes(docs)

    def stats(x: Column) -> Column:
        s = x["sizes"]
        return F.struct(
            x["level"].alias("level"), F.size(s).alias("n"), F.size(F.filter(s, lambda v: v > max_chars)).alias("big"), F.size(F.filter(s, lambda v: v < min_chars)).alias("tiny"),
            F.element_at(F.array_sort(s), (F.floor(F.size(s) / 2) + 1).cast("int")).alias("median"),
            F.aggregate(s, F.lit(0).cast("long"), lambda a, v: a + F.abs(v - goal)).alias("off"),
        )

    df = df.withColumn("_stats", F.transform("_levels", stats))

    def score(x: Column) -> Column:
        many = F.when(x["n"] > SOFT_CHUNKS, F.log((x["n"] - SOFT_CHUNKS + 1).cast("double")) * 10.0).otherwise(0.0)
        value = x["big"] / x["n"] * 100.0 + x["tiny"] / x["n"] * 80.0 + (x["off"] / x["n"]) / scale * 20.0 + F.abs(x["median"] - goal) / scale * 10.0 + many
        return F.struct(value.alias("score"), x["level"].alias("level"))

    return df.withColumn("_scores", F.transform("_stats", score))


def choose_header_level(docs: DataFrame, **params) -> DataFrame:
    """``doc_id, level, score`` of the best level, ties to the lower."""
    best = level_scores(docs, **params).select("doc_id", F.array_min("_scores").alias("b"))
    return best.select("doc_id", "b.level", F.round("b.score", 6).alias("score"))


_FENCES = ("```", "~~~")


def sections_of(text: str, deepest: int, strip_headers: bool) -> list[tuple[list[str | None], str]]:
    """(titles of levels 1 to 6, content) of each section, by one pass over the lines."""
    stack: list[tuple[int, str]] = []
    blocks: list[tuple[tuple[tuple[int, str], ...], list[str]]] = []
    lines: list[str] = []
    under: tuple[tuple[int, str], ...] = ()
    fence = ""

    def close() -> None:
        nonlocal lines
        if lines:
            blocks.append((under, lines))
            lines = []

    for raw in text.split("\n"):
        line = "".join(c for c in raw.strip() if c.isprintable())
        if fence:
            if line.startswith(fence):
                fence = ""
            lines.append(line)
            continue
        opened = next((f for f in _FENCES if line.startswith(f)), "")
        if opened and (opened == "~~~" or line.count(opened) == 1):
            fence = opened
            lines.append(line)
            continue
        hashes = len(line) - len(line.lstrip("#"))
        if 1 <= hashes <= deepest and (len(line) == hashes or line[hashes] == " "):
            close()
            while stack and stack[-1][0] >= hashes:
                stack.pop()
            stack.append((hashes, line[hashes:].strip()))
            under = tuple(stack)
            if not strip_headers:
                lines.append(line)
        elif line:
            lines.append(line)
        else:
            close()
            under = tuple(stack)
    close()

    merged: list[tuple[tuple[tuple[int, str], ...], str]] = []
    for heads, content in blocks:
        piece = "\n".join(content)
        if merged and merged[-1][0] == heads:
            merged[-1] = (heads, merged[-1][1] + "  \n" + piece)
        elif merged and not strip_headers and merged[-1][0] != heads and len(merged[-1][0]) < len(heads) and merged[-1][1].split("\n")[-1].startswith("#"):
            merged[-1] = (heads, merged[-1][1] + "  \n" + piece)
        else:
            merged.append((heads, piece))
    out = []
    for heads, content in merged:
        titles: list[str | None] = [None] * MAX_LEVEL
        for k, title in heads:
            titles[k - 1] = title
        out.append((titles, content))
    return out


#: What is known of a document's origin goes on to its sections and chunks.
CARRIED = ("source_id", "source_file")


def split_by_headers(docs: DataFrame, strip_headers: bool = False) -> DataFrame:
    """Rows (doc_id, level, text) to ``doc_id, level, section, headers, content``, with ``source_id, source_file`` where they have them."""
    carried = [c for c in CARRIED if c in docs.columns]
    text = pa.string()
    own = [("section", pa.int32()), ("headers", pa.list_(text)), ("content", text)]
    schema = pa.schema([("doc_id", text), ("level", pa.int32()), *((c, text) for c in carried), *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end in byte_slices(b.column("text")):
                part, rows = b.slice(start, end - start), []
                for d, level, *more, t in zip(*(part.column(c).to_pylist() for c in ("doc_id", "level", *carried, "text")), strict=True):
                    rows += [(d, level, *more, i, h, c) for i, (h, c) in enumerate(sections_of(t or "", level, strip_headers))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    strings = [F.col(c).cast("string").alias(c) for c in ("doc_id", *carried)]
    made = "doc_id string, level int, " + "".join(f"{c} string, " for c in carried) + "section int, headers array<string>, content string"
    return docs.select(*strings, F.col("level").cast("int").alias("level"), "text").mapInArrow(run, made)


def header_path(headers: Column) -> Column:
    """Non-empty titles joined by ' > '."""
    return F.array_join(F.filter(headers, lambda h: h.isNotNull() & (h != "")), " > ")


def pieces_of(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` where a separator allows it; a separator stays with what follows it."""
    sep, rest = separators[-1], ()
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, rest = s, separators[i + 1 :] if s else ()
            break
    if sep:
        cut = text.split(sep)
        parts = [p for p in [cut[0], *(sep + c for c in cut[1:])] if p]
    else:
        parts = list(text)
    out: list[str] = []
    held: list[str] = []
    total = 0

    def emit() -> None:
        if joined := "".join(held).strip():
            out.append(joined)

    for p in parts:
        if len(p) >= size:
            emit()
            held, total = [], 0
            out += pieces_of(p, size, overlap, rest) if rest else [p]
            continue
        if total + len(p) > size and held:
            emit()
            while total > overlap or (total + len(p) > size and total > 0):
                total -= len(held[0])
                held = held[1:]
        held.append(p)
        total += len(p)
    emit()
    return out


def split_oversize(sections: DataFrame, size: int = 2500, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """Adds ``pieces`` (array) from ``remainder``."""

    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([pieces_of(t, size, overlap, separators) if t is not None else None for t in texts])

    return sections.withColumn("pieces", F.pandas_udf(cut, "array<string>")("remainder"))


#: Leading blank lines and header lines of a section.
LEADING = r"(?d)^(?:[^\S\n]*\n)*((?:[ \t]{0,3}#{1,6}[^\S\n]+[^\n]*(?:\n|$))*)"


def carry_header_block(content: Column) -> tuple[Column, Column]:
    """(leading header lines, the rest) of a section."""
    block = F.trim(F.regexp_extract(content, LEADING, 1))
    return F.regexp_replace(block, r"\n+$", ""), F.regexp_replace(F.regexp_replace(content, LEADING, ""), r"^\n+", "")


def chunk_documents(
    docs: DataFrame,
    max_header_level: int = 0,
    strip_headers: bool = False,
    max_chars: int = 6000,
    piece: int = 2500,
    overlap: int = 200,
    separators: tuple[str, ...] = SEPARATORS,
    with_path: bool = True,
    prefix: str = "PATH: ",
    min_chars: int = 900,
    target: int | None = None,
) -> DataFrame:
    """The whole job: ``doc_id, section, piece, level, header_path, is_subchunk, subchunk_index, text, h1..h6`` and the documents'
    ``source_id, source_file`` where they have them. ``subchunk_index`` counts the pieces of a section that was cut."""
    check_parameters(max_header_level, max_chars, piece, overlap, prefix, min_chars, target)
    carried = [c for c in CARRIED if c in docs.columns]
    if max_header_level:
        leveled = docs.select("doc_id", *carried, F.lit(max_header_level).alias("level"), "text")
    else:
        leveled = level_scores(docs, max_chars, min_chars, target).select("doc_id", *carried, F.array_min("_scores")["level"].alias("level"), "text")
    sections = split_by_headers(leveled, strip_headers).withColumn("header_path", header_path(F.col("headers")))
    block, rest = carry_header_block(F.col("content"))
    over = F.length("content") > max_chars
    sections = sections.withColumn("block", F.when(over, block)).withColumn("remainder", F.when(over & (F.trim(rest) != ""), rest))
    head = F.when(F.lit(with_path) & (F.col("header_path") != ""), F.concat(F.lit(prefix), "header_path", F.lit("\n\n"))).otherwise("")
    # one pass: a section that fits is its own only piece
    cut = split_oversize(sections, piece, overlap, separators)
    bodies = F.when(F.col("remainder").isNull(), F.array("content")).otherwise(F.col("pieces"))
    rows = cut.select("doc_id", *carried, "section", "level", "headers", "header_path", head.alias("head"), "block", F.col("remainder").isNotNull().alias("is_subchunk"), F.posexplode_outer(bodies).alias("piece", "body"))
    parts = F.array(F.rtrim(F.regexp_replace("head", r"\s+$", "")), F.col("block"), F.trim("body"))
    text = F.when(F.col("is_subchunk"), F.concat(F.array_join(F.filter(parts, lambda p: p != ""), "\n\n"), F.lit("\n"))).otherwise(F.concat("head", "body"))
    stack = [F.get("headers", F.lit(k)).alias(f"h{k + 1}") for k in range(6)]
    index = F.when(F.col("is_subchunk"), F.col("piece"))
    return rows.filter("body IS NOT NULL").select("doc_id", "section", "piece", "level", "header_path", "is_subchunk", index.alias("subchunk_index"), text.alias("text"), *stack, *carried)


def number_chunks(chunks: DataFrame) -> DataFrame:
    """Adds ``chunk_index``, the place of a chunk in its whole document, from 0."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "piece")) - 1)


HEADERS_SQL = r"""
pieces AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM (
    SELECT doc_id, string_split(regexp_replace(text, '(?m)^(#{1,6})\s+(.+?)\s*$', chr(1) || '\0', 'g'), chr(1)) AS p FROM source_md)),
placed AS (SELECT doc_id, i, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) - length(p) AS start FROM pieces),
headers AS (SELECT doc_id, start::INT AS start, length(regexp_extract(p, '^(#{1,6})\s', 1))::INT AS level, trim(regexp_extract(p, '^#{1,6}\s+([^\n]+)', 1)) AS title FROM placed WHERE i > 1),
sections AS (
    SELECT doc_id, level, (row_number() OVER w - 1)::INT AS section, (lead(start, 1, n) OVER w - start)::INT AS size FROM (
        SELECT d.doc_id, l.level, s.start, d.n FROM (SELECT m.doc_id, length(m.text) AS n, greatest(1, coalesce(max(h.level), 1)) AS deep FROM source_md m LEFT JOIN headers h USING (doc_id) GROUP BY ALL) d
        JOIN (SELECT unnest(range(1, 7))::INT AS level) l ON l.level <= d.deep
        JOIN (SELECT doc_id, start, level AS hl FROM headers UNION ALL SELECT doc_id, 0, 0 FROM source_md) s ON s.doc_id = d.doc_id AND s.hl <= l.level
        GROUP BY ALL)
    WINDOW w AS (PARTITION BY doc_id, level ORDER BY start)),
scores AS (SELECT doc_id, level,
    count_if(size > 6000) / count(*) * 100.0 + count_if(size < 900) / count(*) * 80.0 + (sum(abs(size - 3900)) / count(*)) / 3900.0 * 20.0
    + abs(list_sort(list(size))[count(*) // 2 + 1] - 3900) / 3900.0 * 10.0 + CASE WHEN count(*) > 4000 THEN ln(count(*) - 3999) * 10.0 ELSE 0 END AS score
    FROM sections GROUP BY doc_id, level)"""
