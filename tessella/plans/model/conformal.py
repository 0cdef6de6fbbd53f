"""Bin-conditional conformal intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.binning import value_bin
from tessella.operators.ranges import running_sums


def quantile_of(df: DataFrame, c: str, level: Column, by: list[str]) -> DataFrame:
    """(by, n, q): the quantile, linearly interpolated, at a level that may differ by group (an expression over n).

    Spark's percentile takes constant levels only, so the two values at the level's place are picked by running counts of
    the distinct values, range by range.
    """
    counts = df.where(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count("*").alias("_n"))
    placed = running_sums(counts, {"_upto": "_n"}, [F.col(c)], by, {"n": "_n"}).withColumn("_at", level * (F.col("n") - 1))
    share = F.col("_at") - F.floor("_at")
    holds = lambda place: ((place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_n"))).cast("int")
    weight = holds(F.floor("_at")) * (1 - share) + holds(F.ceil("_at")) * share
    return placed.groupBy(*by).agg(F.max("n").alias("n"), F.sum(weight * F.col(c)).alias("q"))


def level(n: Column, alpha: float) -> Column:
    """(1 - alpha) (n + 1) / n, 1 at most."""
    return F.least(F.lit(1.0), (1 - alpha) * (n + 1) / n)


def fit(df: DataFrame, truth: str, predicted: str, edges: list[float], alpha: float = 0.1) -> DataFrame:
    """(bin, n, q) for every bin of the true value: the quantile of the absolute errors; empty bins get that of all rows."""
    scored = df.select(value_bin(F.col(truth), edges).alias("bin"), F.abs(F.col(truth) - F.col(predicted)).alias("e")).where("bin is not null")
    binned = quantile_of(scored, "e", level(F.col("n"), alpha), ["bin"])
    overall = quantile_of(scored.withColumn("_g", F.lit(0)), "e", level(F.col("n"), alpha), ["_g"]).select(F.col("q").alias("_q"))
    bins = df.sparkSession.range(len(edges)).select(F.col("id").cast("int").alias("bin"))
    return bins.join(F.broadcast(binned), "bin", "left").crossJoin(F.broadcast(overall)).select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("q", "_q").alias("q"))


def intervals(df: DataFrame, predicted: str, quantiles: DataFrame, edges: list[float], contiguous: bool = True, floor: float = 0.0) -> DataFrame:
    """df with lower and upper: predicted -/+ the error quantile of the prediction's bin, or of the widest bin if contiguous."""
    q = quantiles.agg(F.max("q").alias("q")) if contiguous else quantiles.select("bin", "q")
    if contiguous:
        joined = df.crossJoin(F.broadcast(q))
    else:
        joined = df.withColumn("bin", F.coalesce(value_bin(F.col(predicted), edges), F.lit(0))).join(F.broadcast(q), "bin", "left").drop("bin")
    return joined.withColumns({"lower": F.greatest(F.lit(floor), F.col(predicted) - F.col("q")), "upper": F.col(predicted) + F.col("q")}).drop("q")


def coverage(df: DataFrame, truth: str, edges: list[float]) -> DataFrame:
    """(bin, n, coverage, mean_width, median_width) by the true value's bin."""
    inside = F.col(truth).between(F.col("lower"), F.col("upper")).cast("int")
    width = F.col("upper") - F.col("lower")
    return df.groupBy(value_bin(F.col(truth), edges).alias("bin")).agg(F.count("*").alias("n"), F.avg(inside).alias("coverage"), F.avg(width).alias("mean_width"), F.percentile(width, 0.5).alias("median_width"))


def quartile_edges(df: DataFrame, c: str, log_scale: bool = True) -> list[float]:
    """0, 1, the quartiles of the values above 0 and infinity; without the quartiles if fewer than 4 values are above 0.

    log_scale: the column holds log1p of the values. The edges stand as they come, so with quartiles of 1 and less or equal
    ones a bin is empty.
    """
    value = F.expm1(c) if log_scale else F.col(c)
    row = df.select(value.alias("v")).where("v > 0").agg(F.count("*").alias("n"), F.percentile("v", [0.25, 0.5, 0.75]).alias("q")).first()
    return [0.0, 1.0, *(row["q"] if row["n"] >= 4 else ()), math.inf]


def post_process(df: DataFrame, most_log: float = 500.0, most_upper: float = 1000.0) -> DataFrame:
    """From the log scale: predicted, lower and upper back by expm1, clipped; risk_score is the upper bound."""
    back = lambda c, most: F.least(F.lit(most), F.greatest(F.lit(0.0), F.expm1(F.least(F.col(c), F.lit(700.0)))))
    return df.withColumns({"predicted": back("predicted", most_log), "lower": back("lower", most_upper), "upper": back("upper", most_upper)}).withColumn("risk_score", F.col("upper"))


def marginal(df: DataFrame, truth: str, predicted: str, alpha: float = 0.1) -> DataFrame:
    """The baseline without bins: one quantile for all rows."""
    return fit(df, truth, predicted, [float("-inf")], alpha)
