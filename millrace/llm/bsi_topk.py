"""Exact top-k inner products over a bit-sliced index.

Index: vectors are quantised to integers, dealt into blocks of rows, and each block keeps its attributes as slices:
one bitmap over the rows per attribute and bit. A query is a weighted sum of attributes. Its weights are written in
non-adjacent form; every signed digit adds the attribute's slices (or their complement, for a negative digit) shifted
to the digit's place, and the bitmaps of each place are reduced by carry-save adders until one slice a place is left.
Selection walks the sum from the most significant slice down, keeping sure rows apart from rows still tied; what is
tied at the boundary is resolved by the smallest id. No row is scored one by one before it is selected.

Queries meet blocks through an equi-join on (block, query block), both counts known beforehand. A block's k rows a
query go on to one ranking a query.

Defined cases: vectors that are null, empty or hold a null or non-finite component and rows with a null id take no
part; vectors of different lengths never meet; a repeated row counts each time, but never for a query with its own id;
empty tables give no rows. Extra columns are ignored. Finite components of any size are ranked exactly: those that pass
64 bits are Python integers in blocks of their own. A score that does not fit a long is null, its rank still exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm._common import materialise, table

SCALE = 256
#: Rows of an index block and the most queries that meet it in one task.
BLOCK_ROWS = 16384
BLOCK_QUERIES = 2048
#: Quantised components up to which a block's numbers are 64-bit integers, and the rows that a wider vector counts for.
NARROW = float(1 << 60)
WIDE_ROWS = 16
#: Scores are clamped to a long; ``beyond`` orders those that do not fit.
OUT = "qid long, query_id long, vec_id long, score long, beyond string"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``rid, vec_id, dim, wide, x``: usable vectors, and whether a component's floor(scale * x) needs more than 64 bits."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).filter(F.coalesce(usable, F.lit(False)))
    wide = F.exists(x, lambda v: F.abs(v * float(scale)) >= NARROW)
    return rows.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vec_id"), F.size(vec_col).alias("dim"), wide.alias("wide"), x.alias("x"))


def _integers(vectors: pd.Series, scale: int) -> np.ndarray:
    """floor(scale * x) of equally long vectors: 64-bit integers, or Python's where a component needs more."""
    x = np.stack(vectors.to_numpy()).astype(float)
    with np.errstate(over="ignore"):
        q = np.floor(x * float(scale))
    if (np.abs(q) < NARROW).all():
        return q.astype(np.int64)
    whole = [int(b) if np.isfinite(b) else int(a) * scale for a, b in zip(x.ravel(), q.ravel(), strict=True)]
    return np.array(whole, object).reshape(x.shape)


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 to rows of 64-bit words."""
    pad = -bits.shape[-1] % 64
    bits = np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, pad)])
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def build_block(scale: int = SCALE):
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        """One index block: ids ascending, lowest value, width and slices of each attribute."""
        frame = frame.sort_values("vec_id", kind="stable")
        v = _integers(frame["x"], scale)
        low = v.min(axis=0)
        u = (v - low).T
        width = np.array([int(x).bit_length() for x in u.max(axis=1)], np.int64)
        slices = [_pack(((a[None, :] >> b) & 1).astype(np.uint8)) for a, w in zip(u, width, strict=True) for b in range(w)]
        slices = np.concatenate(slices) if slices else np.zeros((0, -(-len(v) // 64)), np.uint64)
        one = {"ib": frame["ib"].iloc[0], "dim": v.shape[1], "wide": frame["wide"].iloc[0], "ids": frame["vec_id"].to_numpy(np.int64).tobytes(), "low": [str(x) for x in low], "width": width.tobytes(), "slices": slices.tobytes()}
        return pd.DataFrame([one])

    return build


def digits(q: np.ndarray) -> np.ndarray:
    """Non-adjacent form of integers: digits -1, 0, 1, least first, on a new last axis."""
    q, out = q.copy() if q.dtype == object else q.astype(np.int64), []
    while (q != 0).any():
        d = np.where((q & 1) != 0, 2 - (q & 3), 0)
        out.append(d.astype(np.int8))
        q = (q - d) >> 1
    return np.stack(out or [np.zeros(q.shape, np.int8)], axis=-1)


def weighted_sum(slices: np.ndarray, both: np.ndarray, base: np.ndarray, width: np.ndarray, form: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of sum(weight * attribute), least first, and the constant that the complements add."""
    dim, place = np.nonzero(form)
    negative = form[dim, place] < 0
    keep = width[dim] > 0
    dim, place, negative = dim[keep], place[keep], negative[keep]
    shift = -int(sum(int(2) ** int(b) * (2 ** int(w) - 1) for b, w in zip(place[negative], width[dim[negative]], strict=True)))
    w = width[dim]
    bit = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
    row = np.repeat(base[dim] + negative * len(slices), w) + bit
    column = np.repeat(place, w) + bit
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, carried, c = [], [], 0
    last = int(column[-1]) if len(column) else -1
    while c <= last or carried:
        lo, hi = np.searchsorted(column, [c, c + 1])
        stack = both[row[lo:hi]]
        if carried:
            stack = np.concatenate([stack, *carried])
        carried = []
        while len(stack) > 2:
            n = len(stack) // 3
            x, y, z = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
            half = x ^ y
            carried.append((x & y) | (z & half))
            stack = np.concatenate([half ^ z, stack[3 * n :]]) if len(stack) > 3 * n else half ^ z
        if len(stack) == 2:
            carried.append((stack[:1] & stack[1:]))
            stack = stack[:1] ^ stack[1:]
        out.append(stack[0] if len(stack) else np.zeros(both.shape[1], np.uint64))
        c += 1
    return out, shift


def select_top(sums: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest rows: from the most significant slice down, boundary ties to the first rows."""
    sure, tied = np.zeros_like(valid), valid
    have, left = 0, int(np.bitwise_count(tied).sum())
    if left > k:
        for s in reversed(sums):
            ones = tied & s
            n = int(np.bitwise_count(ones).sum())
            if have + n > k:
                tied, left = ones, n
            else:
                sure, have = sure | ones, have + n
                tied, left = tied & ~s, left - n
            if have == k:
                break
    rows = lambda b: np.flatnonzero(np.unpackbits(b.view(np.uint8), bitorder="little"))
    return np.concatenate([rows(sure), rows(tied)[: max(0, k - have)]])


def _beyond(score: int) -> str | None:
    """A text that orders scores outside 64 bits as their values, around "m" for all others."""
    if -(1 << 63) <= score < 1 << 63:
        return None
    text = str(abs(score))
    text = f"{len(text):04}{text}"
    return "p" + text if score > 0 else "a" + text.translate(str.maketrans("0123456789", "9876543210"))


def search_block(k: int, scale: int = SCALE):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(index) and len(queries):
            b = index.iloc[0]
            ids, width = (np.frombuffer(b[c], np.int64) for c in ("ids", "width"))
            low = [int(x) for x in b["low"]]
            reach = [max(abs(x), abs(x + (1 << int(w)))) for x, w in zip(low, width, strict=True)]
            words = -(-len(ids) // 64)
            slices = np.frombuffer(b["slices"], np.uint64).reshape(-1, words)
            both, base = np.concatenate([slices, ~slices]), np.cumsum(width) - width
            everyone = _pack(np.ones((1, len(ids)), np.uint8))[0]
            q = _integers(queries["x"], scale)
            for j, (qid, query_id) in enumerate(zip(queries["qid"], queries["query_id"], strict=True)):
                if j % 64 == 0:
                    forms = digits(q[j : j + 64])
                sums, shift = weighted_sum(slices, both, base, width, forms[j % 64])
                valid = everyone
                lo, hi = np.searchsorted(ids, [query_id, query_id + 1])
                if hi > lo:
                    own = np.zeros((1, len(ids)), np.uint8)
                    own[0, lo:hi] = 1
                    valid = everyone & ~_pack(own)[0]
                at = select_top(sums, valid, k)
                weights = [int(x) for x in q[j]]
                start = shift + sum(x * y for x, y in zip(weights, low, strict=True))
                small = sum(abs(x) * y for x, y in zip(weights, reach, strict=True)) < 1 << 62
                if small:  # the sum fits 64 bits, whatever its parts do: count modulo 2^64
                    score, beyond = np.full(len(at), start % (1 << 64), np.uint64), None
                    for c, s in enumerate(sums[:64]):
                        score += ((s[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)) << np.uint64(c)
                    score = score.view(np.int64)
                else:
                    exact = [start + sum(((int(s[i >> 6]) >> (i & 63)) & 1) << c for c, s in enumerate(sums)) for i in at.tolist()]
                    score = np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in exact], np.int64)
                    beyond = [_beyond(x) for x in exact]
                found.append(pd.DataFrame({"qid": qid, "query_id": query_id, "vec_id": ids[at], "score": score, "beyond": pd.Series(beyond, range(len(at)), dtype=object)}))
        return pd.concat(found) if found else pd.DataFrame({c.split()[0]: pd.Series(dtype="int64" if c.endswith("long") else object) for c in OUT.split(", ")})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query row's k largest integer inner products."""
    rows = materialise(quantised(vectors, id_col, vec_col, scale), "vectors")
    asked = materialise(quantised(queries, id_col, vec_col, scale), "queries")
    n, n_asked = rows.agg(F.sum(F.when(F.col("wide"), WIDE_ROWS).otherwise(1))).first()[0] or 0, asked.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    per = min(BLOCK_QUERIES, max(32, -(-n_asked * blocks // 24)))
    query_blocks = max(1, -(-n_asked // per))
    index = rows.withColumn("ib", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")).groupBy("ib", "dim", "wide").applyInPandas(build_block(scale), "ib int, dim int, wide boolean, ids binary, low array<string>, width binary, slices binary")
    index = materialise(index, "bsi").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = asked.select(F.col("rid").alias("qid"), F.col("vec_id").alias("query_id"), "dim", "x", F.pmod(F.xxhash64("rid"), F.lit(query_blocks)).cast("int").alias("qb"))
    asked = asked.withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kinds = [r.wide for r in rows.select("wide").distinct().collect()]
    asked = asked.withColumn("wide", F.explode(F.array(*map(F.lit, kinds)) if kinds else F.array(F.lit(False))))
    keys = ["ib", "qb", "dim", "wide"]
    best = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search_block(k, scale), OUT)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc(F.coalesce("beyond", F.lit("m"))), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.when(F.col("beyond").isNull(), F.col("score")).alias("score"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
