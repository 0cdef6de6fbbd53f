"""Scales for maps and charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def min_max(c: str, by: str) -> Column:
    """Place between the group's least and largest value; 0 where they are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(F.col(c).isNotNull(), F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0))


def max_abs(c: str, by: str) -> Column:
    """Value over the group's largest absolute one; 0 where that is 0."""
    most = F.max(F.abs(c)).over(Window.partitionBy(by))
    return F.when(F.col(c).isNotNull(), F.when(most > 0, F.col(c) / most).otherwise(0.0))


def clipped(df: DataFrame, c: str, out: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Place between two quantiles of all values, cut off at 0 and 1; the quantiles are one broadcast row."""
    q = df.agg(F.percentile(c, low).alias("_low"), F.percentile(c, high).alias("_high"))
    scaled = F.when(F.col("_high") > F.col("_low"), (F.col(c) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    return df.crossJoin(F.broadcast(q)).withColumn(out, F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))).drop("_low", "_high")


def natural_breaks(df: DataFrame, c: str, classes: int, most: int = 512) -> list[float]:
    """Upper bounds of classes with the least squared deviation within them.

    Values are first counted at `most` quantiles at most, so the search on the driver has a bounded size.
    """
    n = df.select(c).distinct().limit(most + 1).count()
    if n > most:
        edges = [i / most for i in range(most + 1)]
        cuts = sorted(set(df.agg(F.percentile(c, edges)).first()[0]))
        points = [(float(x), 1.0) for x in cuts]
    else:
        points = sorted((float(r[0]), float(r[1])) for r in df.where(F.col(c).isNotNull()).groupBy(c).count().collect())
    if len(points) <= classes:
        return [x for x, _ in points]
    w, s, q = [0.0], [0.0], [0.0]
    for x, k in points:
        w.append(w[-1] + k)
        s.append(s[-1] + k * x)
        q.append(q[-1] + k * x * x)
    cost = lambda i, j: q[j] - q[i] - (s[j] - s[i]) ** 2 / (w[j] - w[i])
    best = [cost(0, j) if j else 0.0 for j in range(len(points) + 1)]
    cut = []
    for k in range(2, classes + 1):
        new, where = [float("inf")] * (len(points) + 1), [0] * (len(points) + 1)
        for j in range(k, len(points) + 1):
            new[j], where[j] = min((best[i] + cost(i, j), i) for i in range(k - 1, j))
        best = new
        cut.append(where)
    bounds, j = [points[-1][0]], len(points)
    for where in reversed(cut):
        j = where[j]
        bounds.append(points[j - 1][0])
    return bounds[::-1]
