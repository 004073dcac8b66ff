"""Structured Streaming twins of the ordered operators: an extension, with watermarks for late rows."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding_counts(stream: DataFrame, at: str, by: list[str], size: str, hop: str, late: str) -> DataFrame:
    """Rows per sliding window; rows later than ``late`` are dropped."""
    return stream.withWatermark(at, late).groupBy(*by, F.window(at, size, hop).alias("w")).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    return stream.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))


def _keyed(stream: DataFrame, key: str, at: str, value: str, kind: str, empty, flags, idle_ms: int | None) -> DataFrame:
    """key, at, value, is_on: ``flags(carried, values)`` gives a batch's flags, in time order, and what its key carries on.

    Rows older than the last one of their key that was processed are late and left out, as behind a watermark. A
    key without rows for ``idle_ms`` (processing time) loses its state and starts anew, so states don't pile up in a
    query that runs on; a run over what is there (``run_available``) needs None, as timeouts would keep it waiting.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        carried, last = state.get if state.exists else (empty, None)
        rows = pd.concat(list(parts)).sort_values(at, kind="stable")
        if last is not None:
            rows = rows[rows[at] >= last]
        if len(rows):
            on, carried = flags(carried, rows[value].to_numpy(float))
            state.update((carried, rows[at].iloc[-1].item() if hasattr(rows[at].iloc[-1], "item") else rows[at].iloc[-1]))
            yield pd.DataFrame({key: rows[key], at: rows[at], value: rows[value], "is_on": on})
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    out = f"{key} {kinds[key]}, {at} {kinds[at]}, {value} double, is_on boolean"
    return stream.select(key, at, value).groupBy(key).applyInPandasWithState(step, out, f"carried {kind}, last {kinds[at]}", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def hysteresis_stream(stream: DataFrame, key: str, at: str, value: str, on: float, off: float, idle_ms: int | None = None) -> DataFrame:
    """key, at, value, is_on: a key carries one boolean. A batch is one running maximum of its last crossings."""

    def flags(active: bool, v: np.ndarray) -> tuple[np.ndarray, bool]:
        i = np.arange(len(v))
        last_on = np.maximum.accumulate(np.where(v > on, i, -1 if active else -3))
        last_off = np.maximum.accumulate(np.where(v > off, -2, i))
        state = last_on > last_off
        return state, bool(state[-1])

    return _keyed(stream, key, at, value, "boolean", False, flags, idle_ms)


def n_of_m_stream(stream: DataFrame, key: str, at: str, value: str, limit: float, n: int, m: int, idle_ms: int | None = None) -> DataFrame:
    """key, at, value, is_on: a key carries its last m flags (a series shorter than m counts what it has)."""

    def flags(last: list[int], v: np.ndarray) -> tuple[np.ndarray, list[int]]:
        all_ = np.concatenate([np.asarray(last, int), (v > limit).astype(int)])
        sums = np.concatenate([np.zeros(m, int), np.cumsum(all_)])
        return (sums[m:] - sums[:-m])[len(last) :] >= n, all_[-m:].tolist()

    return _keyed(stream, key, at, value, "array<int>", [], flags, idle_ms)


def run_available(result: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a streaming plan over what is there, to Parquet at ``out``, and reads the result."""
    q = result.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(out)
