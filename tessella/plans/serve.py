"""The read API: slices of predictions, panel and static features as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.aggregates import covered
from tessella.operators.ranking import newest, top_absolute, top_n
from tessella.operators.windows import over_cell

#: Days that a horizon looks ahead.
HORIZON_DAYS = {"14d": 14, "1m": 28, "2m": 56, "3m": 84}


def allowed(column: str, df: DataFrame) -> str:
    """The column, if the table has it: requested names never reach a query unchecked."""
    if column not in df.columns:
        raise ValueError(f"no such column: {column}")
    return column


def dates(df: DataFrame, date: str = "date", **filters) -> DataFrame:
    for c, v in filters.items():
        if v is not None:
            df = df.where(F.col(allowed(c, df)) == v)
    return df.select(date).distinct().orderBy(date)


def at_date(df: DataFrame, date: str | None = None, c: str = "date") -> DataFrame:
    """Rows of one date, the newest if none is given; that is one row, which is broadcast."""
    if date is not None:
        return df.where(F.col(c) == F.lit(date).cast("date"))
    return df.join(F.broadcast(df.agg(F.max(c).alias(c))), c)


def forecast_date(date: Column, horizon: Column) -> Column:
    days = F.create_map(*[F.lit(x) for kv in HORIZON_DAYS.items() for x in kv])
    return F.date_add(date, F.coalesce(F.try_element_at(days, horizon), F.lit(14)))


def predictions(pred: DataFrame, horizon: str, date: str | None = None, learner: str | None = None) -> DataFrame:
    """Cells at a date with expected value, interval width and the date forecast."""
    p = pred.where(F.col("horizon") == horizon)
    p = at_date(p.where(F.col("learner") == learner) if learner else p, date)
    return p.withColumns({"expected": F.col("prob") * F.col("predicted"), "width": F.col("upper") - F.col("lower"), "forecast_date": forecast_date(F.col("date"), F.col("horizon"))})


def predictions_by_unit(pred: DataFrame, static: DataFrame, unit: str, horizon: str, date: str | None = None, learner: str | None = None) -> DataFrame:
    """Cells with their unit's mean probability and value and its summed expectation and bounds."""
    p = predictions(pred, horizon, date, learner).join(static.select("cell", allowed(unit, static)), "cell")
    by_unit = p.where(F.col(unit).isNotNull()).groupBy(unit).agg(F.avg("prob").alias("prob"), F.avg("predicted").alias("predicted"), F.sum("expected").alias("expected"), F.sum("lower").alias("lower"), F.sum("upper").alias("upper"))
    return p.select("cell", unit).join(by_unit, unit)


def prediction_cube(pred: DataFrame, horizon: str, years: int = 5) -> DataFrame:
    """All cells at all dates of the newest years, for one horizon."""
    p = pred.where(F.col("horizon") == horizon)
    newest_date = p.agg(F.max("date").alias("_newest"))
    return p.crossJoin(F.broadcast(newest_date)).where(F.col("date") > F.add_months("_newest", -12 * years)).drop("_newest")


def feature(panel: DataFrame, column: str, date: str | None = None, static: DataFrame | None = None, unit: str | None = None, how: str = "mean", threshold: float = 0.5) -> DataFrame:
    """A panel feature at a date (the newest with a value), for each cell, or for each unit with enough coverage."""
    c = allowed(column, panel)
    there = at_date(panel.where(F.col(c).isNotNull()), date) if date is None else at_date(panel, date)
    when = there.select("date").limit(1)
    rows = panel.join(F.broadcast(when), "date").select("cell", "date", c)
    return rows if unit is None else covered(rows.join(static.select("cell", unit), "cell"), unit, c, how, threshold)


def static_feature(static: DataFrame, column: str, cell: int | None = None) -> DataFrame:
    rows = static.select("cell", allowed(column, static))
    return rows if cell is None else rows.where(F.col("cell") == cell)


def history(pred: DataFrame, cell: int, horizon: str) -> DataFrame:
    """One cell's predictions over time, with the change since the date before."""
    p = pred.where((F.col("cell") == cell) & (F.col("horizon") == horizon))
    return p.withColumn("change", F.col("prob") - F.lag("prob").over(over_cell())).orderBy("date")


def summary(panel: DataFrame, static: DataFrame, unit: str, column: str) -> DataFrame:
    """For each date the largest, least and mean of the units' sums."""
    c = allowed(column, panel)
    by_unit = panel.join(static.select("cell", unit), "cell").groupBy("date", unit).agg(F.sum(c).alias("v"))
    return by_unit.groupBy("date").agg(F.max("v").alias("max_v"), F.min("v").alias("min_v"), F.avg("v").alias("mean_v"))


def unit_series(panel: DataFrame, static: DataFrame, unit: str, column: str) -> DataFrame:
    """For each date and unit the mean, sum and median of a feature."""
    c = allowed(column, panel)
    return panel.join(static.select("cell", unit), "cell").groupBy("date", unit).agg(F.avg(c).alias("mean_v"), F.sum(c).alias("sum_v"), F.percentile(c, 0.5).alias("median_v"))


def events(df: DataFrame, order: list[Column], n: int, since: str | None = None, date: str = "date") -> DataFrame:
    """The first n events (2000 at most) of an order, since a date."""
    return top_n(df.where(F.col(date) >= F.lit(since).cast("date")) if since else df, order, n)


def parent_unit(static: DataFrame, child: str, parent: str, name: str) -> DataFrame:
    return static.where(F.col(child) == name).select(parent).distinct().orderBy(parent).limit(1)


def explanations(expl: DataFrame, cell: int | None = None, k: int = 3) -> DataFrame:
    """Each cell's newest explanation, its k largest contributions by absolute value."""
    rows = expl if cell is None else expl.where(F.col("cell") == cell)
    grouped = rows.groupBy("cell", "date").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("items"))
    return newest(grouped, ["cell"], ["date"]).select("cell", "date", top_absolute(F.col("items"), k, "value").alias("top"))


def feature_list(df: DataFrame, keys: tuple[str, ...] = ("cell", "date")) -> list[str]:
    return [c for c in df.columns if c not in keys]
