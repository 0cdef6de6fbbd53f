"""Placing dates on the step grid, and values in bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _day(anchor: str) -> Column:
    return F.lit(anchor).cast("date")


def bin_right_closed(date: Column, anchor: str, days: int, n_steps: int, include_lowest: bool = False) -> Column:
    """Label of the interval (step i - 1, step i] that holds the date, which is step i; null outside.

    The anchor itself is outside, unless include_lowest puts it into the first interval. No date gets the first step.
    """
    i = F.ceil(F.datediff(date, _day(anchor)) / days)
    if include_lowest:
        i = F.when(date == _day(anchor), 1).otherwise(i)
    return F.when(i.between(1, n_steps - 1), F.date_add(_day(anchor), (i * days).cast("int")))


def snap_left_closed(date: Column, anchor: str, days: int, lag_days: int = 0) -> Column:
    """Start of the interval [step i, step i + 1) that holds the date, moved by a lag first."""
    i = F.floor((F.datediff(date, _day(anchor)) + lag_days) / days)
    return F.date_add(_day(anchor), (i * days).cast("int"))


def publication_lag(date: Column, n_steps: int, days: int) -> Column:
    return F.date_add(date, n_steps * days)


def aligned_windows(spark: SparkSession, anchor: str, start: str, end: str, days: int) -> DataFrame:
    """(window_start, window_end) of the grid's windows from the first that begins at start or later; the last is clipped at end."""
    return spark.sql(
        f"""select window_start, least(date_add(window_start, {days - 1}), date'{end}') as window_end from (
            select explode(sequence(date_add(date'{anchor}', cast(ceil(datediff(date'{start}', date'{anchor}') / {days}) as int) * {days}), date'{end}', interval {days} days)) as window_start)"""
    )


def value_bin(value: Column, edges: list[float]) -> Column:
    """Index of the bin [edge i, edge i + 1) that holds the value, the last without an upper edge; null below the first."""
    out = F.lit(None).cast("int")
    for i, edge in enumerate(edges):
        out = F.when(value >= edge, F.lit(i)).otherwise(out)
    return out
