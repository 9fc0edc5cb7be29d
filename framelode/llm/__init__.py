"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, so many at once: a batch may hold all texts of a task, which Python need not hold a second time."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)
