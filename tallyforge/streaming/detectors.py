"""Structured Streaming twins of the order-dependent operators.

Event time is a timestamp column; rows of a key that arrive late by up to the watermark are put in order before they are judged.
State per key is a few numbers and the rows that wait for the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Rows that wait for the watermark are kept in state as parallel arrays.
_STATE = "times array<timestamp>, values array<double>, kept_time timestamp, kept_value double"


def _ordered(state: GroupState, batches: Iterator[pd.DataFrame], at: str, value: str, final: bool) -> tuple[list, tuple]:
    """The rows that the watermark has passed, in order, and what is left waiting."""
    times, values, kept_time, kept_value = state.get if state.exists else ([], [], None, None)
    rows = list(zip(map(pd.Timestamp, times), values))
    for pdf in batches:
        rows += list(zip(pdf[at].map(pd.Timestamp), pdf[value].astype(float)))
    rows.sort()
    mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
    ready = rows if final else [r for r in rows if r[0] <= mark]
    return ready, (rows[len(ready) :], None if kept_time is None else pd.Timestamp(kept_time), kept_value)


def _fold(step: Callable[[pd.Timestamp | None, float | None, pd.Timestamp, float], tuple[tuple | None, tuple]], at: str, value: str, key: str):
    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        final = state.hasTimedOut
        ready, (waiting, kept_time, kept_value) = _ordered(state, iter(()) if final else batches, at, value, final)
        out = []
        for t, v in ready:
            emitted, (kept_time, kept_value) = step(kept_time, kept_value, t, v)
            if emitted is not None:
                out.append((group[0], *emitted))
        if final:
            if kept_time is not None and step.closes:
                out.append((group[0], kept_time, kept_value))
            state.remove()
        else:
            state.update(([t.to_pydatetime() for t, _ in waiting], [v for _, v in waiting], None if kept_time is None else kept_time.to_pydatetime(), kept_value))
            last = max([t for t, _ in waiting] + ([kept_time] if kept_time is not None else []))
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + step.wait_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, at, value])

    return run


class _Nearby:
    """Proximity de-duplication: the kept detection is emitted once the next one is too far away to replace it."""

    closes = True

    def __init__(self, gap: pd.Timedelta):
        self.gap, self.wait_ms = gap, int(gap.total_seconds() * 1000)

    def __call__(self, kept, strength, t, v):
        if kept is None:
            return None, (t, v)
        if t - kept <= self.gap:
            return None, (t, v) if v > strength else (kept, strength)
        return (kept, strength), (t, v)


class _Skip:
    """Skip scan: a hit is emitted and hides the following ones."""

    closes = False

    def __init__(self, skip: pd.Timedelta):
        self.skip, self.wait_ms = skip, int(skip.total_seconds() * 1000)

    def __call__(self, kept, strength, t, v):
        if kept is not None and t - kept < self.skip:
            return None, (kept, strength)
        return (t, v), (t, v)


def _stateful(stream: DataFrame, key: str, at: str, value: str, delay: str, step) -> DataFrame:
    kind = dict(stream.dtypes)[key]
    rows = stream.select(key, F.col(at).cast("timestamp").alias(at), F.col(value).cast("double").alias(value)).withWatermark(at, delay)
    run = _fold(step, at, value, key)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {at} timestamp, {value} double", _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def keep_strongest_nearby(stream: DataFrame, key: str, at: str, value: str, gap: str, delay: str = "20 seconds") -> DataFrame:
    """Streaming twin of operators.sequences.keep_strongest_nearby."""
    return _stateful(stream, key, at, value, delay, _Nearby(pd.Timedelta(gap)))


def suppress_after(stream: DataFrame, key: str, at: str, value: str, skip: str, delay: str = "20 seconds") -> DataFrame:
    """Streaming twin of operators.sequences.suppress_after."""
    return _stateful(stream, key, at, value, delay, _Skip(pd.Timedelta(skip)))


def sessions(stream: DataFrame, key: str, at: str, quiet: str, delay: str = "20 seconds") -> DataFrame:
    """Inactivity timeout: activity per key that ends when nothing follows for `quiet`."""
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return rows.groupBy(key, F.session_window(at, quiet).alias("w")).agg(F.count("*").alias("n"), F.max(at).alias("last")).select(key, F.col("w.start").alias("start"), "last", "n")


def upsert_latest(folder: str, key: str, revision: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps each batch's rows with the highest revision per key; a batch that runs again replaces itself.

    The reader takes the latest revision over all batches (latest).
    """

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != key]
        best = batch.groupBy(key).agg(F.max_by(F.struct(*rest), revision).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))
        best.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")

    return write


def latest(df: DataFrame, key: str, revision: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (key, "batch")]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), revision).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))
