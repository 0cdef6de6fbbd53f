"""State a cell with event-time timers: rows wait for the watermark, and states of silent cells expire."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


class TimedDecay(StatefulProcessor):
    """y = alpha x + (1 - alpha) y, row by row in the order of their time, whatever order they come in.

    A row waits under its time until the watermark has passed it; a timer then folds it into the state and gives it out. A state that
    no row has reached for idle_days of event time is dropped, and the next row begins anew.
    """

    def __init__(self, cell: str, ts: str, value: str, alpha: float, idle_days: int):
        self.cell, self.ts, self.value, self.alpha, self.idle_ms = cell, ts, value, alpha, idle_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "x double, n long")
        self.last = handle.getValueState("last", "y double, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            sums = batch.assign(**{self.value: batch[self.value].fillna(0.0)}).groupby(self.ts)[self.value].agg(["sum", "count"])
            for at, x, n in zip(sums.index, sums["sum"], sums["count"], strict=True):
                ms = at.value // 1_000_000 if at.unit == "ns" else int(at.timestamp() * 1000)
                before = self.waiting.getValue((ms,)) if self.waiting.containsKey((ms,)) else (0.0, 0)
                self.waiting.updateValue((ms,), (before[0] + float(x), int(before[1] + n)))
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.waiting.containsKey((now,)):
            x = self.waiting.getValue((now,))[0]
            self.waiting.removeKey((now,))
            state = self.last.get() if self.last.exists() else None
            if state is not None and now - state[1] > self.idle_ms:
                state = None
            y = x if state is None else self.alpha * x + (1 - self.alpha) * state[0]
            self.last.update((y, now))
            self.handle.registerTimer(now + self.idle_ms + 1)
            yield pd.DataFrame({self.cell: [key[0]], self.ts: [pd.Timestamp(now, unit="ms")], "decayed": [y]})
        elif self.last.exists() and now - self.last.get()[1] > self.idle_ms:
            self.last.clear()

    def close(self) -> None:
        pass


def timed_decay(rows: DataFrame, cell: str, ts: str, value: str, alpha: float, late_days: int, idle_days: int) -> DataFrame:
    """(cell, ts, decayed) of a stream of rows, each given out when the watermark, late_days behind the newest row, has passed its time.

    Rows may come in any order within the lateness; later ones are dropped. Values at the same time of a cell are summed, nulls count
    as 0; times are taken to the millisecond. State a cell is its waiting rows and one number, and nothing once it was
    silent for idle_days. The stream needs the state store that `rocksdb` sets.
    """
    marked = rows.select(cell, F.col(ts).cast("timestamp").alias(ts), F.col(value).cast("double").alias(value)).withWatermark(ts, f"{late_days} days")
    schema = f"{cell} {dict(rows.dtypes)[cell]}, {ts} timestamp, decayed double"
    return marked.groupBy(cell).transformWithStateInPandas(TimedDecay(cell, ts, value, alpha, idle_days), schema, "append", "EventTime")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams begun in the block keep their state in RocksDB, which timers need; the session is as before after it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
