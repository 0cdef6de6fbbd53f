"""Training and test rows by date, and predictions held against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_split(df: DataFrame, date: str, cutoff: str, convention: str) -> DataFrame:
    """df with part, train or test.

    before: training ends before the cutoff, which begins the test. upto: the cutoff's day still trains. from: only rows from
    the cutoff on are kept, all of them test. Rows without a date are in neither part.
    """
    day, at = F.col(date).cast("date"), F.lit(cutoff).cast("date")
    if convention == "from":
        return df.where(day >= at).withColumn("part", F.lit("test"))
    trains = {"before": day < at, "upto": day <= at}[convention]
    return df.where(day.isNotNull()).withColumn("part", F.when(trains, "train").otherwise("test"))


def with_truth(predictions: DataFrame, targets: DataFrame, keys: list[str], predicted: str, truth: str) -> DataFrame:
    """Keys with y_pred and y_true of the rows that both have; nulls count as 0."""
    both = predictions.select(*keys, F.col(predicted).alias("y_pred")).join(targets.select(*keys, F.col(truth).alias("y_true")), keys)
    return both.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("y_pred", "y_true")})


def residuals_by_cell(rows: DataFrame, cell: str, least: float = 0.05) -> DataFrame:
    """(cell, n, residual): mean of y_pred - y_true over the rows with an event or a prediction over `least`."""
    return rows.where((F.col("y_true") > 0) | (F.col("y_pred") > least)).groupBy(cell).agg(F.count("*").alias("n"), F.avg(F.col("y_pred") - F.col("y_true")).alias("residual"))


def hits_by_cell(rows: DataFrame, cell: str, threshold: float) -> DataFrame:
    """(cell, tp, fn, fp) at a threshold of y_pred."""
    event, called = F.col("y_true") > 0, F.col("y_pred") >= threshold
    return rows.groupBy(cell).agg(F.count_if(event & called).alias("tp"), F.count_if(event & ~called).alias("fn"), F.count_if(~event & called).alias("fp"))
