"""Helpers shared by the corpus operators: scratch tables, row identity, bounded broadcasts, slices of batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.lineage import discard, shared, written

scratch, materialise = shared, written
__all__ = ["byte_slices", "discard", "held_out", "hinted", "materialise", "scratch", "table", "text_key", "worker_memory"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(col: str | Column) -> Column:
    """With doc_id this identifies a row: rows equal in both have equal results by definition."""
    return F.xxhash64(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))


def hinted(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Broadcast ``df`` only if its counted ``rows`` stay within ``bound``; else leave a shuffled join."""
    return F.broadcast(df) if rows <= bound else df


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the third of rows whose labels must never be learned from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def byte_slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows with at most ``size`` bytes of text; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield start, end
        start = end


def worker_memory(owner: Hashable = None, make: Callable[[], Any] = lambda: None) -> Any:
    """What this worker process keeps for the tasks of one owner: another owner's call drops it, none keeps nothing.

    Spark reuses workers, so without this a stage would hold its memory for all stages after it. What the one before has
    freed goes back to the system, too, as far as the allocators can give it.
    """
    kept = sys.__dict__.get("_millrace_memory")
    if kept is None or kept[0] != owner:
        sys.__dict__.pop("_millrace_memory", None)
        kept = None
        gc.collect()
    if owner is None or kept is None:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)
    if kept is None:
        kept = sys.__dict__["_millrace_memory"] = (owner, make())
    return kept[1]
