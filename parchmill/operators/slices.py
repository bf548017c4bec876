"""A batch's texts a few at a time, so that what a task makes of them stays small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # of texts handled at once; a longer text is handled alone


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The rows of a string column in runs of at most `limit` bytes (or one row), uncopied."""
    wide = pa.types.is_large_string(texts.type)
    where = texts.buffers()[1]
    if where is None:
        return
    ends = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(ends, int(ends[row]) + limit, "right")) - 1)
        yield texts.slice(row, end - row)
        row = end
