"""Work inside tasks on slices of bounded bytes, whatever the size of an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
SLICE_ROWS = 20_000


def byte_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows with at most ``size`` bytes of text; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield start, end
        start = end


def text_rows(make: Callable[[str], Iterator[tuple]], keys: list[str], schema: pa.Schema) -> Callable:
    """For mapInArrow: the rows that ``make`` yields for each text, behind the text's key columns, a bounded number at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            texts, rows = b.column("text"), []
            for start, end in byte_slices(texts):
                part = b.slice(start, end - start)
                for *key, text in zip(*(part.column(c).to_pylist() for c in (*keys, "text")), strict=True):
                    for row in make(text) if text else ():
                        rows.append((*key, *row))
                        if len(rows) >= SLICE_ROWS:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)
                    rows = []

    return run
