"""Checks of data contracts: one row a check, with what was found and whether it passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _row(df: DataFrame, name: str, found: Column, ok) -> DataFrame:
    return df.agg(found.cast("double").alias("found")).select(F.lit(name).alias("check"), "found", F.coalesce(ok(F.col("found")), F.lit(False)).alias("passed"))


def id_type(tables: dict[str, DataFrame], column: str) -> dict[str, bool]:
    """Whether the cell column of each table that has it is a long."""
    return {name: isinstance(df.schema[column].dataType, T.LongType) for name, df in tables.items() if column in df.columns}


def no_nulls(df: DataFrame, c: str) -> DataFrame:
    return _row(df, f"no null in {c}", F.count_if(F.col(c).isNull()), lambda x: x == 0)


def in_range(df: DataFrame, c: str, low: float, high: float) -> DataFrame:
    return _row(df, f"{c} within {low:g} and {high:g}", F.count_if(~F.col(c).between(low, high)), lambda x: x == 0)


def gaps(df: DataFrame, date: str, most_days: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, date, next_date, days) where the next date is more than so many days away; of the distinct dates."""
    ahead = F.lead(date).over((Window.partitionBy(*by) if by else Window).orderBy(date))
    return df.select(*by, date).distinct().withColumn("next_date", ahead).withColumn("days", F.datediff("next_date", date)).where(F.col("days") > most_days)


def alignment(df: DataFrame, date: str, days: int) -> DataFrame:
    """Distinct dates against those that the grid has between the first and the last."""
    return df.agg(F.count_distinct(date).alias("n_dates"), F.floor(F.datediff(F.max(date), F.min(date)) / days + 1).cast("long").alias("n_expected")).withColumn("aligned", F.col("n_dates") == F.col("n_expected"))


def prevalence(df: DataFrame, c: str, least: float) -> DataFrame:
    return _row(df, f"prevalence of {c}", F.avg((F.coalesce(F.col(c), F.lit(0)) > 0).cast("int")), lambda x: x > least)


def unique_key(df: DataFrame, keys: list[str]) -> DataFrame:
    name = f"unique {', '.join(keys)}"
    return _row(df.groupBy(*keys).count(), name, F.count_if((F.col("count") > 1) | reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])), lambda x: x == 0)


def float_like_integers(df: DataFrame, c: str) -> DataFrame:
    return _row(df, f"no decimals in {c}", F.count_if(F.col(c).cast("string").rlike(r"^\d+\.0$")), lambda x: x == 0)


def score_range(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, low, high, all_zero) of score columns, in one pass."""
    found = [F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.coalesce(F.max(F.abs(c)) == 0, F.lit(True)).alias("all_zero")) for c in columns]
    return df.agg(F.array(*found).alias("r")).select(F.inline("r"))


def null_report(df: DataFrame, expected: dict[str, float], tolerance: float = 0.05) -> DataFrame:
    """(column, observed, expected, status): null rates within the tolerance are ok, others low or high. One pass."""
    observed = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in expected]).unpivot([], list(expected), "column", "observed")
    known = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])[F.col("column")]
    status = F.when(F.abs(F.col("observed") - F.col("expected")) <= tolerance, "ok").when(F.col("observed") < F.col("expected"), "low").otherwise("high")
    return observed.withColumn("expected", known).withColumn("status", status)


def non_scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def prerequisites(spark: SparkSession, needs: dict[str, list[str]], tables: dict[str, DataFrame]) -> list[str]:
    """What is missing: tables, and columns of tables."""
    missing = [t for t in needs if t not in tables]
    return missing + [f"{t}.{c}" for t, cs in needs.items() if t in tables for c in cs if c not in tables[t].columns]


def all_checks(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def structural_flags(df: DataFrame, flags: list[str], date: str = "date") -> DataFrame:
    """(flag, share, first_date) of 0/1 columns: how often each is 1, and since when."""
    found = [F.struct(F.lit(f).alias("flag"), F.avg((F.col(f) == 1).cast("int")).alias("share"), F.min(F.when(F.col(f) == 1, F.col(date))).alias("first_date")) for f in flags]
    return df.agg(F.array(*found).alias("r")).select(F.inline("r"))


def selected_columns(columns: list[str], include: list[str] = (), exclude: list[str] = (), pattern: str | None = None) -> list[str]:
    """The columns that are included (all, if none is named), match the pattern, and are not excluded."""
    import re

    chosen = [c for c in columns if c in include] if include else list(columns)
    return [c for c in chosen if c not in exclude and (pattern is None or re.search(pattern, c))]
