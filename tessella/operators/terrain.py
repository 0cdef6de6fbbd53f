"""Slope and ruggedness of pixel tables: a 3 x 3 stencil over tiles with a halo."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a tile: a task holds (side + 2) squared pixels.
TILE = 256


def terrain(pixels: DataFrame, nodata: float | None = None, scale: float = 1.0, size: tuple[float, float] = (1.0, 1.0), rule: str = "riley", tile: int = TILE) -> DataFrame:
    """row, col, value, slope (degrees, by Horn's weights) and ruggedness of each pixel (row, col, value); rows run south, columns east.

    `size` is a pixel's width and height, `scale` how many of these units a unit of the value has. Ruggedness is the root of
    the summed squared differences to the eight neighbours ("riley") or their mean absolute difference ("wilson").
    A null, NaN or `nodata` value has null results. Beyond the table's first and last row and column, pixels go on in a straight line
    from the last two (at corners, with the last column repeated); a neighbour without a value counts as the pixel itself. Of
    several rows for a pixel the greatest value stays. Rows without row or col are dropped; other columns are not read.

    One shuffle by tile: border pixels go to the neighbouring tiles as well, 4 / tile of all.
    """
    if rule not in ("riley", "wilson"):
        raise ValueError(f"no such rule: {rule}")
    value = F.col("value").cast("double")
    valid = F.when(~F.isnan(value) & (F.lit(True) if nodata is None else value != nodata), value)
    own = pixels.select(F.col("row").cast("long"), F.col("col").cast("long"), valid.alias("value")).where("row is not null and col is not null")
    ends = own.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    near = lambda c: F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor((F.col(c) + d) / tile)))
    dealt = own.withColumn("tr", F.explode(near("row"))).withColumn("tc", F.explode(near("col")))

    def stencil(keys: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        top, left = (k.as_py() * tile for k in keys)
        rows, cols = group["row"].to_numpy() - top + 1, group["col"].to_numpy() - left + 1
        values = group["value"].to_numpy(zero_copy_only=False).astype(float)
        grid, seen = np.full((tile + 2, tile + 2), np.nan), np.zeros((tile + 2, tile + 2), bool)
        np.fmax.at(grid, (rows, cols), values)
        seen[rows, cols] = True
        r, c = np.nonzero(seen[1:-1, 1:-1])
        slope, rugged = _stencil(grid, r, c, (r + top, c + left), ends, scale, size, rule)
        middle = grid[r + 1, c + 1]
        out = lambda v: pa.array(v, pa.float64(), mask=np.isnan(middle))
        return pa.table({"row": pa.array(r + top, pa.int64()), "col": pa.array(c + left, pa.int64()), "value": out(middle), "slope": out(slope), "ruggedness": out(rugged)})

    return dealt.groupBy("tr", "tc").applyInArrow(stencil, "row long, col long, value double, slope double, ruggedness double")


def _stencil(grid: np.ndarray, r: np.ndarray, c: np.ndarray, place: tuple[np.ndarray, np.ndarray], ends: tuple[int, int, int, int], scale: float, size: tuple[float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    w = np.array([[grid[r + i, c + j] for j in range(3)] for i in range(3)])
    north, south, west, east = place[0] == ends[0], place[0] == ends[1], place[1] == ends[2], place[1] == ends[3]
    level = north | south
    beyond = lambda a, b: np.where(level, a, 2 * a - b)
    w[:, 0], w[:, 2] = np.where(west, beyond(w[:, 1], w[:, 2]), w[:, 0]), np.where(east, beyond(w[:, 1], w[:, 0]), w[:, 2])
    w[0], w[2] = np.where(north, 2 * w[1] - w[2], w[0]), np.where(south, 2 * w[1] - w[0], w[2])
    w = np.where(np.isnan(w), w[1, 1], w)
    dx = ((w[0, 0] + 2 * w[1, 0] + w[2, 0]) - (w[0, 2] + 2 * w[1, 2] + w[2, 2])) / size[0]
    dy = ((w[2, 0] + 2 * w[2, 1] + w[2, 2]) - (w[0, 0] + 2 * w[0, 1] + w[0, 2])) / size[1]
    off = w - w[1, 1]
    rugged = np.sqrt((off * off).sum((0, 1))) if rule == "riley" else np.abs(off).sum((0, 1)) / 8
    return np.degrees(np.arctan(np.sqrt(dx * dx + dy * dy) / (8 * scale))), rugged
