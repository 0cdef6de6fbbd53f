"""Aggregations, reshaping and row-wise sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "count_distinct": F.count_distinct}


def by_rule(df: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """One aggregation with a rule a column."""
    return df.groupBy(*keys).agg(*[RULES[rule](c).alias(c) for c, rule in rules.items()])


def multi_rule(df: DataFrame, keys: list[str], rules: dict[str, tuple[str, str]]) -> DataFrame:
    """One aggregation: out to (rule, column); first takes the least value that is not null, so that reruns agree."""
    return df.groupBy(*keys).agg(*[(F.min if rule == "first" else RULES[rule])(c).alias(out) for out, (rule, c) in rules.items()])


def mean_with_attributes(df: DataFrame, keys: list[str], values: list[str], attributes: list[str]) -> DataFrame:
    """Means of the values, and of each attribute the least value that is not null."""
    return multi_rule(df, keys, {c: ("mean", c) for c in values} | {c: ("first", c) for c in attributes})


def damped(raw: str, cells: str) -> Column:
    """A score over the root of the number of cells that share it."""
    return F.col(raw) / F.sqrt(F.col(cells))


def weighted_if_known(score: str, weight: str) -> Column:
    """score * (1 + weight) where the weight is above 0, else the score."""
    return F.when(F.col(weight) > 0, F.col(score) * (1 + F.col(weight))).otherwise(F.col(score))


def rule_by_name(columns: list[str]) -> dict[str, str]:
    """max for columns whose name holds 'risk', else sum."""
    return {c: "max" if "risk" in c else "sum" for c in columns}


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient in which a denominator of 0 counts as 1."""
    return numerator / F.when(denominator == 0, F.lit(1)).otherwise(denominator)


def pivot(df: DataFrame, keys: list[str], column: str, values: list[str], value: str, how: str = "mean") -> DataFrame:
    """A column for each of the given values; listing them saves a pass over the data. Combinations without rows are null."""
    return df.groupBy(*keys).pivot(column, values).agg(RULES[how](value))


def unpivot_nonzero(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Long form (keys, variable, value) without zeros and nulls."""
    return df.unpivot(keys, columns, "variable", "value").where("value <> 0")


def row_mean(columns: list[str]) -> Column:
    """Mean of the columns that are not null; null if none is."""
    n = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    return F.when(n > 0, row_sum(columns) / n)


def row_sum(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])


def weighted_sum(weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) * w for c, w in weights.items()])


def interaction(a: str, b: str) -> Column:
    """Product, missing as 0."""
    return F.coalesce(F.col(a), F.lit(0)) * F.coalesce(F.col(b), F.lit(0))


def positive_part(c: str, intensity: str) -> Column:
    return F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)) * F.coalesce(F.col(intensity), F.lit(0))


def covered(df: DataFrame, group: str, c: str, how: str = "mean", threshold: float = 0.5) -> DataFrame:
    """Aggregate of each group (not the null one), null where fewer than the threshold of its rows have a value."""
    share = F.count(c) / F.count("*")
    value = {"mean": F.avg(c), "sum": F.sum(c), "median": F.percentile(c, 0.5)}[how]
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.when(share >= threshold, value).alias(c), F.count(c).alias("n_values"), F.count("*").alias("n_rows"))


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_rate), all in one pass."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return rates.unpivot([], columns, "column", "null_rate")


def audit(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """For each (name, table, date, key): first and last date, rows, and distinct keys."""
    rows = [
        t.agg(F.lit(name).alias("source"), F.min(F.col(date).cast("date")).alias("first_date"), F.max(F.col(date).cast("date")).alias("last_date"), F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"))
        for name, t, date, key in tables
    ]
    return reduce(DataFrame.unionByName, rows)


def lethality(events: DataFrame, actor: str, fatalities: str) -> DataFrame:
    """(actor, total, lethality): log1p of each actor's total over the largest one; only totals above 0."""
    totals = events.groupBy(F.lower(F.trim(actor)).alias("actor")).agg(F.sum(fatalities).alias("total")).where("total > 0")
    largest = totals.agg(F.max(F.log1p("total")).alias("_most"))
    return totals.crossJoin(F.broadcast(largest)).select("actor", "total", (F.log1p("total") / F.col("_most")).alias("lethality"))


def latest_year(df: DataFrame, year: str) -> DataFrame:
    """The rows of the newest year; the one-row maximum is broadcast."""
    return df.crossJoin(F.broadcast(df.agg(F.max(year).alias("_latest")))).where(F.col(year) == F.col("_latest")).drop("_latest")
