"""The same operators on streams of usage records and events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Messages delivered more than once, each only the first time, within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_sums(stream: DataFrame, at: str, late: str, length: str, by: list[str], value: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of tumbling or sliding windows; windows close when the watermark passes them."""
    window = F.window(at, length, slide) if slide else F.window(at, length)
    out = stream.withWatermark(at, late).groupBy(window, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("begin"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(stream: DataFrame, at: str, late: str, gap: str, by: list[str]) -> DataFrame:
    """Continuous activity: rows of a key with no gap of at least ``gap`` between them."""
    out = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def counter_deltas(stream: DataFrame, by: str, order: str, counter: str, idle: str = "7 days") -> DataFrame:
    """Differences of a cumulative counter per key; the last reading is the state.

    Rows of one micro-batch are taken in the order of ``order``.  A first
    reading above zero and a decrease give null.  A key that was silent for
    ``idle`` is forgotten; its next reading counts as a first one.
    """

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(order)
        read = rows[counter].dropna()
        before = read.shift()
        if len(read):
            before.iloc[0] = state.get[0] if state.exists else (0 if read.iloc[0] == 0 else float("nan"))
            state.update((int(read.iloc[-1]),))
        state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        delta = read - before
        delta = delta.where(delta >= 0).reindex(rows.index)
        yield pd.DataFrame({by: [key[0]] * len(rows), order: rows[order].to_numpy(), "delta": pd.array(delta, dtype="Int64")})

    fields = {f.name: f.dataType.simpleString() for f in stream.schema}
    return stream.groupBy(by).applyInPandasWithState(update, f"{by} {fields[by]}, {order} {fields[order]}, delta bigint", "last bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)
