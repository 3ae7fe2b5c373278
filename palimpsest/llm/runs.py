"""Sorted rows in Arrow batches, taken key by key inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, its rows) for consecutive rows of equal keys; keys hold no nulls."""
    pending: list[pa.RecordBatch] = []
    last: tuple = ()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        starts = np.zeros(n, dtype=bool)
        starts[0] = True
        for k in keys:
            column = batch.column(batch.schema.get_field_index(k))
            starts[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(starts).tolist()
        for a, b in zip(at, [*at[1:], n], strict=True):
            key = tuple(batch.column(batch.schema.get_field_index(k))[a].as_py() for k in keys)
            if pending and key != last:
                yield last, pa.Table.from_batches(pending)
                pending = []
            last = key
            pending.append(batch.slice(a, b - a))
    if pending:
        yield last, pa.Table.from_batches(pending)
