"""What is left to ingest, and what the catalog knows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def window_to_load(existing: DataFrame | None, date: str, start: dt.date, end: dt.date, force: bool = False, overlap_days: int = 0) -> tuple[dt.date, dt.date] | None:
    """(day after the newest row, end), moved back by the overlap; all if nothing is there or forced; None if all is."""
    newest = None if existing is None or force else existing.agg(F.max(F.col(date).cast("date"))).first()[0]
    if newest is None:
        return start, end
    first = max(start, newest + dt.timedelta(days=1 - overlap_days))
    return None if newest >= end and not overlap_days or first > end else (first, end)


def catalog_overview(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n_columns, date_column, first_date): the first date-like column of each table and its earliest value."""
    rows = []
    for name, df in tables.items():
        dates = [f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
        first = df.agg(F.min(F.col(dates[0]).cast("date"))).first()[0] if dates else None
        rows.append((name, len(df.columns), dates[0] if dates else None, first))
    return spark.createDataFrame(rows, "table string, n_columns long, date_column string, first_date date")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, columns that one lacks as null: a schema that only grows."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
