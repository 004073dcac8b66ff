"""Keyed state in event time: rows wait for the watermark, then their key's state takes them in order of time."""
from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, and gives them to ``flags`` by time (ties: by value).

    State of a key: the list of its waiting rows, what it carries on, and the time of its last row. A timer stands at
    the first waiting row; when none waits, at ``idle_ms`` behind the last row, and then the key's state goes. So what
    comes out is decided by the rows' times alone: not by their order of arrival, nor by how they are cut into batches.
    """

    def __init__(self, key: str, kind: str, empty, flags: Callable, idle_ms: int):
        self.key, self.kind, self.empty, self.flags, self.idle_ms = key, kind, empty, flags, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, value double")
        self.carried = handle.getValueState("carried", f"value {self.kind}, last long")

    def _set_timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def _out(self, key, at: np.ndarray, value: np.ndarray, on: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(at), "us": at, "value": value, "is_on": on})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat([r[["row_us", "row_value"]] for r in rows])
        held = [*self.waiting.get()] if self.waiting.exists() else []
        held += [(int(a), float(v)) for a, v in zip(fresh["row_us"], fresh["row_value"], strict=True)]
        self.waiting.put(held)
        self._set_timer(min(a for a, _ in held) // 1000)
        yield self._out(key, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted((int(a), float(v)) for a, v in self.waiting.get()) if self.waiting.exists() else []
        ready = [x for x in held if x[0] <= mark * 1000]
        left = held[len(ready) :]
        state = self.carried.get() if self.carried.exists() else None
        at, value = np.array([a for a, _ in ready], np.int64), np.array([v for _, v in ready], float)
        on, last = np.zeros(0, bool), int(state[1]) if state else 0
        if len(ready):
            on, now = self.flags(state[0] if state else self.empty, value)
            last = int(at[-1])
            self.carried.update((now, last))
            self.waiting.put(left) if left else self.waiting.clear()
        if left:
            self._set_timer(left[0][0] // 1000)
        elif last // 1000 + self.idle_ms > mark:
            self._set_timer(last // 1000 + self.idle_ms)
        else:
            self.carried.clear()
        yield self._out(key, at, value, on)

    def close(self) -> None:
        pass


def _keyed(stream: DataFrame, key: str, at: str, value: str, late: str, kind: str, empty, flags: Callable, idle_ms: int) -> DataFrame:
    """key, us, value, is_on. ``at``: a timestamp; rows later than ``late`` are dropped, null ones too; null values are off."""
    rows = stream.filter(F.col(at).isNotNull()).withWatermark(at, late).select(key, F.col(at), F.unix_micros(F.col(at)).alias("row_us"), F.coalesce(F.col(value).cast("double"), F.lit(float("-inf"))).alias("row_value"))
    kind_of_key = stream.schema[key].dataType.simpleString()
    processor = InOrder(key, kind, empty, flags, idle_ms)
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind_of_key}, us long, value double, is_on boolean", "append", "eventtime")


def hysteresis(stream: DataFrame, key: str, at: str, value: str, on: float, off: float, late: str, idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """key, us, value, is_on in order of time: on from a value > on, as long as values stay > off. A key idle for ``idle_ms`` begins anew."""

    def flags(active: bool, v: np.ndarray) -> tuple[np.ndarray, bool]:
        i = np.arange(len(v))
        last_on = np.maximum.accumulate(np.where(v > on, i, -1 if active else -3))
        last_off = np.maximum.accumulate(np.where(v > off, -2, i))
        state = last_on > last_off
        return state, bool(state[-1])

    return _keyed(stream, key, at, value, late, "boolean", False, flags, idle_ms)


def n_of_m(stream: DataFrame, key: str, at: str, value: str, limit: float, n: int, m: int, late: str, idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """key, us, value, is_on in order of time: at least n of the key's last m values exceed ``limit`` (a short series counts what it has)."""

    def flags(last: int, v: np.ndarray) -> tuple[np.ndarray, int]:
        # what is carried: the last m - 1 flags as the bits of a number
        before = np.array([last >> k & 1 for k in range(m - 2, -1, -1)], int)
        every = np.concatenate([before, (v > limit).astype(int)])
        sums = np.concatenate([[0], np.cumsum(every)])
        kept = every[len(every) - (m - 1) :] if m > 1 else []
        return sums[m:] - sums[:-m] >= n, int(sum(int(f) << k for k, f in enumerate(reversed(kept))))

    return _keyed(stream, key, at, value, late, "long", 0, flags, idle_ms)


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which lists and timers need."""
    was = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if was is None else spark.conf.set(STORE, was)
