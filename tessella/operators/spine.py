"""The dense (cell, step) spine and its calendar columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def steps(spark: SparkSession, start: str, end: str, days: int, name: str = "date") -> DataFrame:
    """One row a step: start, start + days, ... up to end."""
    return spark.sql(f"select explode(sequence(date'{start}', date'{end}', interval {int(days)} days)) as `{name}`")


def spine(cells: DataFrame, dates: DataFrame) -> DataFrame:
    """Every cell at every step. The steps are broadcast: a calendar has a known, small number of rows."""
    return cells.crossJoin(F.broadcast(dates))


def with_epoch(dates: DataFrame, date: str = "date") -> DataFrame:
    """Number of the step within its year, from 1; on the calendar, before it meets the cells."""
    return dates.withColumn("epoch", F.dense_rank().over(Window.partitionBy(F.year(date)).orderBy(date)))


def seasonality(date: Column) -> dict[str, Column]:
    """Month as a point on the circle, and the dry season from November to April."""
    angle = 2 * math.pi * F.month(date) / 12
    return {"month_sin": F.sin(angle), "month_cos": F.cos(angle), "is_dry_season": F.month(date).isin(11, 12, 1, 2, 3, 4).cast("int")}
