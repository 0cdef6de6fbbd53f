"""Functions for SQL: temporary ones of expressions, a table function for year ranges, and an aggregate for decay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella.functions import text


class YearRange:
    """One row a year from first to last; none if a bound is null or the range is empty."""

    def eval(self, first: int, last: int):
        if first is not None and last is not None:
            for year in range(first, last + 1):
                yield (year,)


def ewm_last(values: pd.Series, alpha: pd.Series) -> float:
    """The decay's last state over values in the order they come; nulls count as 0."""
    a, y = float(alpha.iloc[0]), None
    for x in values.fillna(0.0):
        y = float(x) if y is None else a * float(x) + (1 - a) * y
    return y if y is not None else 0.0


def register_functions(spark: SparkSession) -> None:
    """year_range, ewm_last, normal_name, quality_weight and haversine_km for use in spark.sql."""
    spark.udtf.register("year_range", F.udtf(YearRange, returnType="year int"))
    spark.udf.register("ewm_last", F.pandas_udf(ewm_last, "double"))
    name = "lower(regexp_replace(coalesce(n, ''), r'^\\s+|\\s+$', ''))"
    for p in text.UNIT_PREFIXES:
        name = f"regexp_replace({name}, '^{p}', '')"
    spark.sql(
        f"""create or replace temporary function normal_name(n string) returns string return
        trim(regexp_replace(translate({name}, '{text.MARKED}', '{text.PLAIN}'), r"[^\\p{{L}}\\p{{N}}]+", ' '))"""
    )
    spark.sql(
        f"""create or replace temporary function quality_weight(t string) returns double return
        case when coalesce(trim(t), '') = '' or size(split(trim(t), r"\\s+")) < 5 then 0.1D when t rlike '(?i){"|".join(text.BOILERPLATE)}' then 0.3D
        else least(1D, greatest(0.1D, size(split(trim(t), r"\\s+")) / 30D)) end"""
    )
    spark.sql(
        """create or replace temporary function haversine_km(a double, b double, c double, d double) returns double return
        2 * 6371.0088D * asin(least(1D, sqrt(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2))))"""
    )
