"""Helpers for single passes over sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext


def partition_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def blocks(batches: Iterator[pa.RecordBatch], rows: int = 65_536) -> Iterator[pa.Table]:
    """The batches of a task, put together to blocks of about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def starts_of_groups(table: pa.Table, keys: list[str], before: tuple | None) -> np.ndarray:
    """Where a row's key differs from the row before; ``before`` is the last key of the earlier block.

    Nulls equal nulls.
    """
    n = table.num_rows
    new = np.zeros(n, bool)
    for key in keys:
        column = table.column(key).combine_chunks()
        a, b = column.slice(1), column.slice(0, n - 1)
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
        if column.null_count:
            nulls = pc.is_null(column).to_numpy(zero_copy_only=False)
            same |= nulls[1:] & nulls[:-1]
        new[1:] |= ~same
    new[0] = before is None or key_at(table, keys, 0) != before
    return new


def key_at(table: pa.Table, keys: list[str], row: int) -> tuple:
    return tuple(table.column(k)[row].as_py() for k in keys)


def running_max(values: np.ndarray, new: np.ndarray, carry: int | None) -> np.ndarray:
    """The running maximum inside each group; ``carry`` continues the group of the first row."""
    if len(values) and carry is not None and not new[0]:
        values = values.copy()
        values[0] = max(values[0], carry)
    return pd.Series(values).groupby(np.cumsum(new)).cummax().to_numpy()
