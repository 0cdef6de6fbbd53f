"""Numbers that came as text, arrays that should be scalars, booleans, missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_WORDS = ("", "nan", "none", "null", "na", "n/a")


def repaired_number(text: Column) -> Column:
    """The number in the text, brackets and blanks aside; null for null words and for text that is none. Never NaN."""
    t = F.lower(F.trim(F.regexp_replace(text.cast("string"), r"[\[\]\s]", "")))
    number = F.when(~t.isin(*NULL_WORDS), t.try_cast("double"))
    return F.when(~F.isnan(number), number)


def acceptance(df: DataFrame, columns: list[str], rule: str = "half") -> dict[str, bool]:
    """Which text columns become numbers, from one pass: 'half' (half of the non-null parse), 'some' (so, and at least one), 'strict' (all but 1 %)."""
    row = df.agg(*[F.count(F.when(F.col(c).isNotNull() & ~F.lower(F.trim(c)).isin(*NULL_WORDS), 1)).alias(f"{c}_n") for c in columns], *[F.count(repaired_number(F.col(c))).alias(f"{c}_ok") for c in columns]).first()
    share = lambda c: row[f"{c}_ok"] / max(1, row[f"{c}_n"])
    tests = {"half": lambda c: share(c) >= 0.5, "some": lambda c: share(c) >= 0.5 and row[f"{c}_ok"] > 0, "strict": lambda c: row[f"{c}_n"] - row[f"{c}_ok"] <= 0.01 * row[f"{c}_n"]}
    return {c: tests[rule](c) for c in columns}


def scalar(array: Column) -> Column:
    """The element of a one-element array, the mean of a longer one, null of an empty one."""
    return F.when(F.size(array) > 0, F.aggregate(array, F.lit(0.0), lambda a, x: a + x) / F.size(array))


def positive_flag(value: Column) -> Column:
    return F.coalesce(value.try_cast("double") > 0, F.lit(False))


def no_nan(df: DataFrame) -> DataFrame:
    """df with null for NaN in all floating columns: done at every scan, as NaN > 0 holds in Spark."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def year_range(df: DataFrame, first: str, last: str, out: str = "year") -> DataFrame:
    """One row a year from first to last."""
    return df.where(F.col(first) <= F.col(last)).withColumn(out, F.explode(F.sequence(first, last)))


def multi_value(field: Column, outer: str = ";", inner: str = "#", parts: int = 6) -> Column:
    """The outer list's items, split by the inner separator, that have enough parts."""
    return F.filter(F.transform(F.split(field, outer), lambda x: F.split(x, inner)), lambda p: F.size(p) >= parts)
