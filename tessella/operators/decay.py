"""Exponential decay of step series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def alpha_of(half_life_steps: float) -> float:
    """Weight of the newest value for a half-life in steps."""
    return 1 - 2 ** (-1 / half_life_steps)


#: Powers of 2 that a segment's weights span, well inside those of a double.
SPAN = 500


def decay_fold(df: DataFrame, c: str, out: str, alpha: float, cell: str = "cell", date: str = "date", step_days: int = 1) -> DataFrame:
    """State y = alpha x + (1 - alpha) y, begun at the first x, for each row of distinct (cell, date); nulls count as 0.

    A scan over segments, at any length: a cell's calendar is cut into segments whose weights fit a double, each is summed by a window of its
    own, and what a segment makes of the state before it, (1 - alpha) ** n y + b, is composed over the cell's segments, of
    which there are few. So a long or hot cell is spread over tasks, and the work is linear in its length. step_days is the
    least distance of a cell's dates; a smaller one than the real only makes more segments.
    """
    x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    if alpha >= 1:
        return df.withColumn(out, x)
    steps = max(1, int(SPAN / abs(math.log2(1 - alpha))))
    rows = df.withColumn("_seg", F.floor(F.datediff(date, F.lit("1970-01-01")) / (steps * step_days)))
    w = Window.partitionBy(cell, "_seg").orderBy(date)
    rows = rows.withColumns({"_i": F.row_number().over(w) - 1, "_x": x})
    weighted = F.sum(F.col("_x") * alpha * F.pow(F.lit(1 - alpha), -F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_own", F.pow(F.lit(1 - alpha), F.col("_i")) * weighted)
    parts = rows.groupBy(cell, "_seg").agg(F.count("*").alias("n"), F.max_by("_own", "_i").alias("b"), F.min_by("_x", "_i").alias("x"))
    parts = parts.groupBy(F.col(cell).alias("_cell")).agg(F.array_sort(F.collect_list(F.struct(F.col("_seg").alias("g"), "n", "b", "x"))).alias("_s"))
    carried = F.expr(
        f"""aggregate(_s, named_struct('y', _s[0].x, 'out', cast(array() as array<struct<g:bigint,y:double>>)),
              (acc, p) -> named_struct('y', p.b + pow({1 - alpha!r}D, p.n) * acc.y, 'out', concat(acc.out, array(named_struct('g', p.g, 'y', acc.y)))), acc -> acc.out)"""
    )
    carries = parts.select("_cell", F.explode(carried).alias("_p")).select("_cell", F.col("_p.g").alias("_g"), F.col("_p.y").alias("_before"))
    joined = rows.join(carries, F.col(cell).eqNullSafe(F.col("_cell")) & (F.col("_seg") == F.col("_g")))
    return joined.withColumn(out, F.col("_own") + F.pow(F.lit(1 - alpha), F.col("_i") + 1) * F.col("_before")).drop("_seg", "_i", "_x", "_own", "_cell", "_g", "_before")


def fits_window(alpha: float, max_steps: int) -> bool:
    """Whether the powers of the closed form stay inside the double range."""
    return max_steps * abs(math.log2(1 - alpha)) <= 1000


def decay_window(df: DataFrame, c: str, out: str, alpha: float, w: WindowSpec, max_steps: int) -> DataFrame:
    """The same state by window functions alone, without a second shuffle; for series up to max_steps.

    y(i) = (1 - alpha)^i (x(0) + sum over j > 0 of alpha x(j) (1 - alpha)^-j).
    """
    if not fits_window(alpha, max_steps):
        raise ValueError("series too long for the closed form; use decay_fold")
    x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    df = df.withColumn("_i", F.row_number().over(w) - 1)
    df = df.withColumn("_part", F.when(F.col("_i") == 0, x).otherwise(x * alpha * F.pow(F.lit(1 - alpha), -F.col("_i"))))
    total = F.sum("_part").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.pow(F.lit(1 - alpha), F.col("_i")) * total).drop("_i", "_part")
