"""Arrow batches in runs of bounded size, for tasks that make Python values of them."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a column that a task turns into Python values at once.
SLICE_BYTES = 1 << 20
#: What a row counts for beside its bytes, which bounds the rows of a run.
ROW_BYTES = 1 << 8


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES, times: int = 1, beside: int = 0) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows that hold at most so many bytes in a column of texts; a longer text is a run of its own.

    A text counts ``times`` its bytes and ``beside`` more, where a task makes longer ones of it.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64) * times + beside + ROW_BYTES)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def give_back() -> None:
    """Return memory that is no longer used to the system: workers outlive their tasks and lie idle beside the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
