"""Running sums and row numbers over a whole table, range by range, so that no task sorts more than one range."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialise, small

#: Rows of a range, about; a table of no more is summed in one window for each key.
RANGE_ROWS = 1_000_000


def running_sums(df: DataFrame, sums: dict[str, str], order: list[Column], by: list[str] = (), totals: dict[str, str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with, for each out: column of sums, the sum of the column over the rows up to and with this one, and over all for totals.

    Rows are written and counted, then dealt to as many ranges of (by, order) as their number asks for; sums a range are summed over
    the ranges before, and the rest is a window within a range. Rows that order leaves equal may lie in either order, so
    pass distinct ones.
    """
    df = materialise(df)
    ranges = math.ceil(df.count() / range_rows)
    if ranges <= 1:
        key = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        upto = key.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({o: F.sum(c).over(upto) for o, c in sums.items()} | {o: F.sum(c).over(key) for o, c in (totals or {}).items()})
    columns = sorted({*sums.values(), *(totals or {}).values()})
    dealt = materialise(df.repartitionByRange(ranges, *by, *order).withColumn("_range", F.spark_partition_id()))
    each = dealt.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(*by, "_range", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns], *[F.sum(f"_s_{c}").over(whole).alias(f"_t_{c}") for c in columns])
    offsets = small(materialise(offsets)).withColumnsRenamed({c: f"_o_{c}" for c in by})
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    joined = dealt.join(offsets.withColumnRenamed("_range", "_at"), same)
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumns({o: F.sum(c).over(within) + F.col(f"_b_{c}") for o, c in sums.items()} | {o: F.col(f"_t_{c}") for o, c in (totals or {}).items()})
    return out.select(*df.columns, *sums, *(totals or {}))


def numbered(df: DataFrame, out: str, order: list[Column], range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with the row's number, from 1, in the order."""
    return running_sums(df.withColumn("_one", F.lit(1).cast("long")), {out: "_one"}, order, range_rows=range_rows).drop("_one")
