"""Frequent values of a stream in bounded memory, with summaries that can be merged."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc


class Summary:
    """A Misra-Gries summary of at most `size` values.

    A value's count is never too high, and too low by total / size at most. So every
    value that is more than one in `size` of all is in it. Summaries of parts, added up
    value by value, have the same bound over the sum of their totals.
    """

    def __init__(self, size: int):
        self.size, self.total = size, 0
        self.counts: dict[str, int] = {}

    def add(self, values: pa.Array) -> None:
        found = pc.value_counts(values)
        self.total += len(values)
        for value, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True):
            self.counts[value] = self.counts.get(value, 0) + n
        if len(self.counts) > self.size:
            # What the next largest count is, all lose; so at least size + 1 values lose it.
            cut = sorted(self.counts.values(), reverse=True)[self.size]
            self.counts = {v: n - cut for v, n in self.counts.items() if n > cut}
