"""Lags, fills, recency, rolling and seasonal measures.

All take a cell and a date column and use one window specification, so that Spark shuffles a panel once for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessella.operators.ranges import running_sums
from tessella.session import materialise, small

EPS = 1e-6


def over_cell(cell: str = "cell", date: str = "date") -> WindowSpec:
    return Window.partitionBy(cell).orderBy(date)


def lag_zero(c: str, w: WindowSpec, n: int = 1) -> Column:
    return F.coalesce(F.lag(c, n).over(w), F.lit(0))


def lag_null(c: str, w: WindowSpec, n: int = 1) -> Column:
    return F.lag(c, n).over(w)


def back_fill(c: str, w: WindowSpec) -> Column:
    """The value or the cell's next one, however late (it looks ahead)."""
    return F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def lag_back_fill(df: DataFrame, c: str, out: str, w: WindowSpec, strict: bool = False, default: float | None = None) -> DataFrame:
    """Lag 1, its gaps filled with later lags of the cell, then with a default; strict leaves the gaps."""
    df = df.withColumn(out, F.lag(c).over(w))
    if not strict:
        df = df.withColumn(out, back_fill(out, w))
    return df if default is None else df.withColumn(out, F.coalesce(out, F.lit(default)))


def difference(c: str, w: WindowSpec) -> Column:
    return F.col(c) - F.lag(c).over(w)


def lead_targets(df: DataFrame, c: str, horizons: dict[str, int], w: WindowSpec) -> DataFrame:
    """For each horizon of k rows: the value there, and whether it is above 0 (null where there is none)."""
    out = {}
    for name, k in horizons.items():
        ahead = F.lead(c, k).over(w)
        out |= {f"target_{name}": ahead, f"target_{name}_binary": (ahead > 0).cast("int")}
    return df.withColumns(out)


def forward_fill(c: str, w: WindowSpec, limit: int | None = None) -> Column:
    """The last value, at most `limit` rows old."""
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0))


def recency(df: DataFrame, c: str, out: str, cell: str = "cell", date: str = "date") -> DataFrame:
    """Days since the value last changed or first appeared; null where the value is. A repeated value is no change."""
    w = over_cell(cell, date)
    before = F.lag(c).over(w)
    changed = F.col(c).isNotNull() & (before.isNull() | (before != F.col(c)))
    df = df.withColumn("_changed", F.when(changed, F.col(date)))
    since = F.datediff(date, F.last("_changed", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn(out, F.when(F.col(c).isNotNull(), since)).drop("_changed")


def rolling_mean(c: str, w: WindowSpec, rows: int) -> Column:
    return F.avg(c).over(w.rowsBetween(-(rows - 1), 0))


def shock(c: str, w: WindowSpec, rows: int = 26) -> Column:
    """Value over its rolling mean; null where the value is."""
    return F.col(c) / (rolling_mean(c, w, rows) + EPS)


def seasonal_z(df: DataFrame, c: str, out: str, baseline_end_year: int, cell: str = "cell", date: str = "date", smooth: int | None = None) -> DataFrame:
    """(value - mean of the cell's month) / (its deviation + eps) by baseline years, smoothed over rows if asked.

    Without any value in the baseline years, all years count. Mean and deviation come from a window on (cell, month), so
    the panel isn't joined with itself; the check for an empty baseline is one aggregated row.
    """
    base = F.when(F.year(date) <= baseline_end_year, F.col(c))
    any_base = df.agg((F.count(base) > 0).alias("_any"))
    df = df.crossJoin(F.broadcast(any_base)).withColumn("_base", F.when(F.col("_any"), base).otherwise(F.col(c)))
    month = Window.partitionBy(cell, F.month(date))
    df = df.withColumn(out, (F.col(c) - F.avg("_base").over(month)) / (F.stddev_samp("_base").over(month) + EPS)).drop("_base", "_any")
    return df.withColumn(out, rolling_mean(out, over_cell(cell, date), smooth)) if smooth else df


def national_lag(df: DataFrame, c: str, out: str, date: str = "date") -> DataFrame:
    """Lag of the per-date sum, the first date back-filled, joined to every row. The calendar's frame is small."""
    by_date = df.groupBy(date).agg(F.sum(c).alias("_sum"))
    w = Window.orderBy(date)
    by_date = by_date.withColumn(out, F.lag("_sum").over(w)).withColumn(out, back_fill(out, w)).drop("_sum")
    return df.join(F.broadcast(by_date), date, "left")


def average_percent_rank(c: str, partition: str) -> Column:
    """Share of rows at or above the value, descending, ties at their mean rank."""
    w = Window.partitionBy(partition)
    ties = F.count("*").over(Window.partitionBy(partition, c))
    return (F.rank().over(w.orderBy(F.col(c).desc())) + (ties - 1) / 2) / F.count("*").over(w)


def average_percent_ranks(df: DataFrame, c: str, out: str) -> DataFrame:
    """df with the share of all rows at or above the value, descending, ties at their mean rank, as average_percent_rank gives it for a partition.

    Rows are counted by value, and the counts summed range by range, so no task sorts all rows; nulls come last.
    """
    counts = running_sums(df.groupBy(F.col(c).alias("_value")).agg(F.count("*").alias("_n")), {"_upto": "_n"}, [F.desc("_value")], totals={"_all": "_n"})
    shares = counts.select("_value", ((F.col("_upto") - (F.col("_n") - 1) / 2) / F.col("_all")).alias(out))
    return df.join(small(materialise(shares)), F.col(c).eqNullSafe(F.col("_value"))).drop("_value")


#: Upper edges of the shares, and names, of the risk tiers.
TIERS = ((0.05, "1_critical"), (0.15, "2_high"), (0.30, "3_elevated"), (1.0, "4_baseline"))


def tier(share: Column) -> Column:
    out = F.when(share <= TIERS[0][0], TIERS[0][1])
    for edge, name in TIERS[1:]:
        out = out.when(share <= edge, name)
    return out


def availability_flag(date: Column, since: str, values: list[str]) -> Column:
    """1 from the date on that a source exists, where any of its values is there."""
    return ((date >= F.lit(since).cast("date")) & F.coalesce(*[F.col(v).cast("string") for v in values]).isNotNull()).cast("int")


def latest_lookup(df: DataFrame, flag: Column, out: str, steps_back: int, cell: str = "cell", position: str = "pos", earliest: bool = False) -> DataFrame:
    """Steps back to a flagged row of the cell, at most steps_back: the latest such row, or the earliest.

    position numbers the dates over all cells, so a missing row of the cell does not shift the distance.
    """
    pick = F.min if earliest else F.max
    w = Window.partitionBy(cell).orderBy(position).rangeBetween(-steps_back, 0)
    return df.withColumn(out, F.col(position) - pick(F.when(flag, F.col(position))).over(w))


def date_positions(df: DataFrame, date: str = "date", out: str = "pos") -> DataFrame:
    """Number each row's date among all dates of the frame, from 0; the dates alone are ranked, then joined back."""
    dates = df.select(date).distinct().withColumn(out, (F.row_number().over(Window.orderBy(date)) - 1).cast("long"))
    return df.join(F.broadcast(dates), date)
