"""Folds in order of events, whose later steps depend on earlier decisions.

Each account's or key's events go through one ordered fold in bounded memory:
rows are dealt by key, sorted, and streamed, so a key's events are never held
together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def _width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def budget_decisions(calls: DataFrame, limit: float) -> DataFrame:
    """(account, seq, allowed, spent) of calls (account, seq, cost): a denied call adds nothing to what was spent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, spent = None, 0.0
        for batch in batches:
            allowed, after = [], []
            for account, cost in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if account != now:
                    now, spent = account, 0.0
                ok = spent + (cost or 0.0) <= limit
                spent += (cost or 0.0) if ok else 0.0
                allowed.append(ok)
                after.append(spent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed), pa.array(after, pa.float64())], ["account", "seq", "allowed", "spent"])

    rows = calls.select("account", "seq", "cost").repartition(_width(calls), "account").sortWithinPartitions("account", "seq")
    return rows.mapInArrow(run, "account long, seq long, allowed boolean, spent double")


def rate_windows(hits: DataFrame, seconds: int, most: int) -> DataFrame:
    """(key, seq, window_start, allowed) of hits (key, seq, at): a window opens at the key's first hit after the last one closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, n = None, 0, 0
        for batch in batches:
            starts, allowed = [], []
            for key, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != now or at >= start + seconds:
                    now, start, n = key, at, 0
                n += 1
                starts.append(start)
                allowed.append(n <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.int64()), pa.array(allowed)], ["key", "seq", "window_start", "allowed"])

    rows = hits.select("key", "seq", "at").repartition(_width(hits), "key").sortWithinPartitions("key", "at", "seq")
    return rows.mapInArrow(run, "key long, seq long, window_start long, allowed boolean")
