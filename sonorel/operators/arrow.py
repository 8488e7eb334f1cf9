"""Rows of Python values as Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BATCH_BYTES, BATCH_ROWS = 8 << 20, 1024


def weight(value: object) -> int:
    """About how many bytes a value takes."""
    if isinstance(value, np.ndarray):
        return value.nbytes
    if isinstance(value, (bytes, str)):
        return len(value)
    return sum(map(weight, value)) if isinstance(value, list) else 8


def in_batches(rows: Iterable[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Small rows go together; a large one goes alone."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(map(weight, row))
        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield _batch(held, names, types)
            held, size = [], 0
    if held:
        yield _batch(held, names, types)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), types)], names)
