"""Arrow batches in slices of bounded text, so a task never holds a whole batch as Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def text_slices(batch: pa.RecordBatch, column: int, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Consecutive slices of a batch with their texts (null for null); a slice has one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + slice_bytes, side="right")))
        part = batch.slice(begin, end - begin)
        yield part, part.column(column).to_pylist()
        begin = end
