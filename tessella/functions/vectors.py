"""Embedding vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def anchor_score(positive: Column, negative: Column) -> Column:
    """Best positive similarity less half of the best negative one, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.array_max(positive) - 0.5 * F.array_max(negative)))


def anchor_uncertainty(similarities: Column) -> Column:
    """1 less the lead of the best similarity over the second, within 0 and 1."""
    s = F.sort_array(similarities, asc=False)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (s[0] - s[1])))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid): mean vector, summed component by component before the shuffle."""
    parts = df.select(key, F.posexplode(vector).alias("_i", "_x")).groupBy(key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centroid"))


def centroid_velocity(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Cosine distance between each key's centroid and the one before; null for the first. Keys are few (months)."""
    before = F.lag("centroid").over(Window.orderBy(key))
    return centroids(df, key, vector).withColumn("velocity", F.when(before.isNotNull(), 1 - cosine(F.col("centroid"), before)))
