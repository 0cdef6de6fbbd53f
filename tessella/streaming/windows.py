"""Panel features over event streams with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from tessella.sources.upsert import VersionedTable

#: 2000-01-01 is 9 days past a multiple of 14 days after the epoch.
GRID_DAYS, GRID_OFFSET_DAYS = 14, 9
#: How late rows of a source may be, in days.
LATENESS = {"news": 7, "displacement": 14, "prices": 14, "environment": 14, "land_cover": 14, "outages": 7}


def deduplicated(events: DataFrame, key: str, ts: str, late_days: int) -> DataFrame:
    """The first event of each id within the watermark; state older than that goes."""
    return events.withWatermark(ts, f"{late_days} days").dropDuplicatesWithinWatermark([key])


def tumbling_steps(events: DataFrame, ts: str, keys: list[str], value: str, late_days: int | None, right_closed: bool = False) -> DataFrame:
    """(keys, date, n, total) of each 14-day step of the grid that begins at 2000-01-01.

    late_days is the watermark; None for a frame that has one already.

    Windows are closed on the left and named by their start; right_closed moves events by a microsecond and names windows by
    their end, as the panel's binning does.
    """
    moved = events.withColumn(ts, F.col(ts) - F.expr("interval 1 microsecond")) if right_closed else events
    marked = moved.withWatermark(ts, f"{late_days} days") if events.isStreaming and late_days is not None else moved
    w = F.window(ts, f"{GRID_DAYS} days", f"{GRID_DAYS} days", f"{GRID_OFFSET_DAYS} days")
    date = F.col("w.end" if right_closed else "w.start").cast("date").alias("date")
    return marked.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*keys, date, "n", "total")


def upsert_sink(df: DataFrame, table: VersionedTable, keys: list[str], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch's recomputed windows replace theirs in the table; running a batch again changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            table.upsert(batch, keys)

    return df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def decay_states(steps: DataFrame, cell: str, date: str, value: str, alpha: float) -> DataFrame:
    """(cell, date, decayed): the decay's state after each row of a stream of closed steps, one double a cell kept between batches.

    Rows of a cell must come in order of their step, as they do from windows in append mode; a batch's rows are sorted.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(date)
        out = []
        for d, x in zip(rows[date], rows[value].fillna(0.0)):
            y = float(x) if y is None else alpha * float(x) + (1 - alpha) * y
            out.append((key[0], d, y))
        state.update((y,))
        yield pd.DataFrame(out, columns=[cell, date, "decayed"])

    schema = f"{cell} {dict(steps.dtypes)[cell]}, {date} date, decayed double"
    return steps.groupBy(cell).applyInPandasWithState(step, schema, "y double", "append", GroupStateTimeout.NoTimeout)


def fill_and_recency(steps: DataFrame, cell: str, date: str, value: str, limit_days: int) -> DataFrame:
    """(cell, date, filled, recency): forward fill of at most limit_days and days since the value last changed, across batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen, changed = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(batches)).sort_values(date)
        out = []
        for d, x in zip(pd.to_datetime(rows[date]), rows[value]):
            day = d.toordinal()
            if pd.notna(x):
                if last is None or x != last or day - seen > limit_days:
                    changed = day
                last, seen = float(x), day
            alive = last is not None and day - seen <= limit_days
            out.append((key[0], d.date(), last if alive else None, float(day - changed) if alive else None))
        state.update((last, seen, changed))
        yield pd.DataFrame(out, columns=[cell, date, "filled", "recency"])

    schema = f"{cell} {dict(steps.dtypes)[cell]}, {date} date, filled double, recency double"
    return steps.groupBy(cell).applyInPandasWithState(step, schema, "last double, seen long, changed long", "append", GroupStateTimeout.NoTimeout)


def run_to_end(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Everything that is available now, then stop."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
