"""The circuit breaker as a stateful processor with a clock."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: failures in a row that open the breaker.
THRESHOLD = 10
CLOSED, OPEN, TRIAL = "closed", "open", "trial"
#: The state store with timers; the session that starts the stream must have it set as its provider.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Breaker(StatefulProcessor):
    """Failures in a row since the last success by `order`, and the phase, of one key.

    A breaker opens at the threshold; after `pause_ms` it allows a trial, whose
    failure opens it again and whose success closes it. A key without results
    for `idle_ms` is forgotten. Late results count by their order: a failure
    before the last success never does, and of a success what older batches
    brought is taken to lie before it. Memory is that of the failures since the
    last success.
    """

    def __init__(self, key: str, order: str, threshold: int, pause_ms: int, idle_ms: int):
        self.key, self.order, self.threshold, self.pause_ms, self.idle_ms = key, order, threshold, pause_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", "streak long, success long, phase string, since long, last long")

    def _put(self, streak: int, success: int | None, phase: str, since: int, last: int) -> None:
        """New state, and the one timer that it needs."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((streak, success, phase, since, last))
        self.handle.registerTimer(since + self.pause_ms if phase == OPEN else last + self.idle_ms)

    def _said(self, key: tuple, streak: int, phase: str) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "streak": [streak], "open": [phase == OPEN], "phase": [phase]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        streak, success, phase, since, _ = self.state.get() if self.state.exists() else (0, None, CLOSED, now, now)
        best, failed, reset = success, np.zeros(0, np.int64), False
        for part in rows:
            at, ok = part[self.order].to_numpy(np.int64), part["success"].to_numpy(bool)
            if ok.any() and (best is None or at[ok].max() > best):
                best, reset = int(at[ok].max()), True
            failed = np.concatenate([failed, at[~ok]])
            if best is not None:
                failed = failed[failed > best]
        streak = len(failed) + (0 if reset else streak)
        if streak >= self.threshold or (phase == TRIAL and len(failed)):
            since, phase = (since if phase == OPEN else now), OPEN
        elif reset:
            phase = CLOSED
        self._put(streak, best, phase, since, now)
        yield self._said(key, streak, phase)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        streak, success, phase, _, last = self.state.get()
        if phase == OPEN:
            self._put(streak, success, TRIAL, now, last)
            yield self._said(key, streak, TRIAL)
        else:
            self.state.clear()
            yield self._said(key, 0, CLOSED)

    def close(self) -> None:
        pass


def circuit_breaker(results: DataFrame, key: str = "tool", order: str = "seq", threshold: int = THRESHOLD, pause_ms: int = 60_000, idle_ms: int = 86_400_000) -> DataFrame:
    """Of a stream (key, order, success) the state of each key after each batch that changes it: streak, open, phase."""
    kind = results.schema[key].dataType.simpleString()
    processor = Breaker(key, order, threshold, pause_ms, idle_ms)
    return results.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, streak long, open boolean, phase string", "Update", "ProcessingTime")
