"""Top-k, newest rows, deduplication and sampling, each with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, order: list[Column], n: int, most: int = 2000) -> DataFrame:
    return df.orderBy(*order).limit(min(n, most))


def newest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key by the given columns; pre-aggregated, so no key's rows are sorted."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*by, *[c for c in rest if c not in by])
    return df.groupBy(*keys).agg(F.max(row).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a stated order."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*order, *[c for c in rest if c not in order])
    return df.groupBy(*keys).agg(F.min(row).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def top_percent(df: DataFrame, partition: str, c: str, tie: str, percent: float, flag_top: int = 20) -> DataFrame:
    """The ceil(n p / 100) highest rows of each partition, p held within 1 to 50, with rank and a flag for the first few."""
    p = min(50.0, max(1.0, percent))
    w = Window.partitionBy(partition)
    ranked = df.withColumns({"rank": F.row_number().over(w.orderBy(F.col(c).desc(), tie)), "_n": F.count("*").over(w)})
    return ranked.where(F.col("rank") <= F.ceil(F.col("_n") * p / 100)).withColumn("is_top", F.col("rank") <= flag_top).drop("_n")


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """A fixed share of the keys, the same on every run and in every partitioning."""
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.where(place % 1_000_000 < int(fraction * 1_000_000))


def split_weights(df: DataFrame, split: Column, parts: dict[str, float], name: str, value: str) -> DataFrame:
    """Rows for which split holds become one row a part, with its share of the value; others stay."""
    shares = F.when(split, F.array(*[F.struct(F.lit(k).alias("n"), F.lit(w).alias("w")) for k, w in parts.items()])).otherwise(F.array(F.struct(F.col(name).alias("n"), F.lit(1.0).alias("w"))))
    return df.withColumn("_p", F.explode(shares)).withColumn(name, F.col("_p.n")).withColumn(value, F.col(value) * F.col("_p.w")).drop("_p")


def top_absolute(items: Column, k: int, value: str) -> Column:
    """The k structs of an array with the largest absolute value; of equal ones the earlier stays first."""
    order = lambda a, b: F.when(F.abs(a[value]) > F.abs(b[value]), -1).when(F.abs(a[value]) < F.abs(b[value]), 1).otherwise(0)
    return F.slice(F.array_sort(items, order), 1, k)
