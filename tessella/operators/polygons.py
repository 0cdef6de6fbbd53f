"""Polygons on the hexagon grid: the cells in a polygon, and the areas that cells and polygons share.

Polygons are rows with `rings`, as GeoJSON has them: arrays of [lon, lat], the outline first and its holes after it. A feature of
several parts is several rows. Areas are those of the plane of degrees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.geo import hex_id

#: Cells a side of the squares that polygons are split into before their cells are met.
TILE = 32
#: Shares of a cell below this are rounding, not overlap.
LEAST_SHARE = 1e-9

Ring = list[tuple[float, float]]


def edges(polygons: DataFrame, key: list[str]) -> DataFrame:
    """key, x1, y1, x2, y2 with y1 < y2: all edges of all rings that aren't level. Rings may be closed or open."""
    ring = F.explode("rings").alias("_ring")
    ends = F.explode(F.arrays_zip(F.col("_ring").alias("a"), F.concat(F.slice("_ring", 2, F.greatest(F.size("_ring"), F.lit(1))), F.slice("_ring", 1, 1)).alias("b"))).alias("_e")
    flat = polygons.select(*key, ring).select(*key, ends).select(*key, *[F.col(f"_e.{p}")[i].alias(n) for p, i, n in (("a", 0, "ax"), ("a", 1, "ay"), ("b", 0, "bx"), ("b", 1, "by"))])
    up = F.col("ay") < F.col("by")
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    return flat.where("ay <> by").select(*key, pick("ax", "bx").alias("x1"), pick("ay", "by").alias("y1"), pick("bx", "ax").alias("x2"), pick("by", "ay").alias("y2"))


def cells_of_polygons(polygons: DataFrame, size: float, key: list[str]) -> DataFrame:
    """key, cell of all cells of that side whose centre is in the polygon, by even-odd crossing; holes are out.

    An edge holds its lower end and not its upper one, and a centre on an edge is in what lies east of it, so of polygons that share
    a border each centre is in one. Key columns name a polygon with all its parts. Edges are dealt to the rows of cells that they
    cross, and a row's crossings are paired from west to east, so no task holds a whole polygon's cells. Rings without area,
    null rings and empty tables give no cells.
    """
    step = 1.5 * size
    row = F.explode(F.sequence(F.ceil(F.col("y1") / step).cast("long"), F.ceil(F.col("y2") / step).cast("long")))
    crossed = edges(polygons, key).withColumn("_r", row).withColumn("_y", F.col("_r") * step).where("y1 <= _y and _y < y2")
    at = F.col("x1") + (F.col("_y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    spans = crossed.select(*key, "_r", at.alias("_x")).groupBy(*key, "_r").agg(F.sort_array(F.collect_list("_x")).alias("_xs"))
    span = F.explode(F.transform(F.sequence(F.lit(0), F.expr("size(_xs) div 2") - 1), lambda i: F.struct(F.get("_xs", 2 * i).alias("w"), F.get("_xs", 2 * i + 1).alias("e"))))
    width, half = size * 3**0.5, F.col("_r") / 2
    q = lambda x: F.floor(F.col(x) / width - half).cast("long")
    cells = spans.where("size(_xs) > 1").select(*key, "_r", span.alias("_s")).select(*key, "_r", "_s.*").withColumn("_q", F.explode(F.sequence(q("w"), q("e") + 1)))
    centre = (F.col("_q") + half) * width
    return cells.where((F.col("w") <= centre) & (centre < F.col("e"))).select(*key, hex_id(F.col("_q"), F.col("_r")).alias("cell"))


def half_plane(ring: Ring, a: float, b: float, c: float) -> Ring:
    """The part of a ring where a * x + b * y <= c."""
    out, n = [], len(ring)
    for i in range(n):
        p, q = ring[i - 1], ring[i]
        dp, dq = a * p[0] + b * p[1] - c, a * q[0] + b * q[1] - c
        if (dp < 0 < dq) or (dq < 0 < dp):
            t = dp / (dp - dq)
            out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if dq <= 0:
            out.append(q)
    return out


def area(ring: Ring) -> float:
    if len(ring) < 3:
        return 0.0
    ox, oy = ring[0]
    return abs(sum((ring[i - 1][0] - ox) * (ring[i][1] - oy) - (ring[i][0] - ox) * (ring[i - 1][1] - oy) for i in range(len(ring)))) / 2


def split(rings: list[Ring], side: float) -> Iterator[list[Ring]]:
    """The rings cut at the lines of a square grid, halving the longer side until a piece lies in one square."""
    rings = [r for r in rings if len(r) > 2]
    if not rings:
        return
    xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    west, east, south, north = math.floor(min(xs) / side), math.ceil(max(xs) / side), math.floor(min(ys) / side), math.ceil(max(ys) / side)
    if east - west <= 1 and north - south <= 1:
        yield rings
        return
    across = east - west >= north - south
    line = ((east + west) // 2 if across else (north + south) // 2) * side
    a, b = (1.0, 0.0) if across else (0.0, 1.0)
    for s in (1, -1):
        first, *holes = [half_plane(r, s * a, s * b, s * line) for r in rings]
        if area(first) > 0:
            yield from split([first, *holes], side)


def shared(rings: list[Ring], size: float) -> Iterator[tuple[int, int, float]]:
    """(q, r, area shared) of the cells that an outline without its holes meets.

    Cells whose box no edge's box touches are all in or all out; the others are clipped at their six sides, which is exact
    for any ring as a cell is convex.
    """
    width, half = size * 3**0.5, size * 3**0.5 / 2
    corners = [(half, size / 2), (0.0, size), (-half, size / 2), (-half, -size / 2), (0.0, -size), (half, -size / 2)]
    whole = 1.5 * width * size
    sides = [(q[1] - p[1], p[0] - q[0]) for p, q in zip(corners, [*corners[1:], corners[0]], strict=True)]
    sides = [(a, b, a * p[0] + b * p[1]) for (a, b), p in zip(sides, corners, strict=True)]
    ends = [np.array([p + q for p, q in zip(r, [*r[1:], r[0]], strict=True)]) for r in rings]
    e = np.concatenate(ends)
    lo_x, hi_x, lo_y, hi_y = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2]), np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    for r in range(math.floor((lo_y.min() - size) / (1.5 * size)), math.ceil((hi_y.max() + size) / (1.5 * size)) + 1):
        y = 1.5 * size * r
        near = (lo_y <= y + size) & (hi_y >= y - size)
        crossing = (lo_y <= y) & (y < hi_y)
        x_at = e[crossing, 0] + (y - e[crossing, 1]) * (e[crossing, 2] - e[crossing, 0]) / (e[crossing, 3] - e[crossing, 1])
        for q in range(math.floor((lo_x.min() - half) / width - r / 2), math.ceil((hi_x.max() + half) / width - r / 2) + 1):
            x = width * (q + r / 2)
            if (near & (lo_x <= x + half) & (hi_x >= x - half)).any():
                both = []
                for ring in rings:
                    cut = [(px - x, py - y) for px, py in ring]
                    for side in sides:
                        cut = half_plane(cut, *side)
                    both.append(area(cut))
                found = both[0] - sum(both[1:])
            else:
                found = whole if (x_at <= x).sum() % 2 else 0.0
            if found > 0:
                yield q, r, found


def polygon_overlaps(polygons: DataFrame, size: float, key: list[str], tile: int = TILE) -> DataFrame:
    """key, cell, area of all cells of that side that share area with the polygon; holes are out, touching isn't sharing.

    Key columns name a polygon; its parts add up. Polygons are first split at the lines of a square grid, then the pieces are
    spread over all tasks and their cells clipped, so a polygon's cells are never all in one task. Rings follow
    each other from any vertex, closed or not, in either direction, and don't cross themselves; holes lie in the outline. Null rings
    give no rows.
    """
    kinds = ", ".join(f"`{c}` {polygons.schema[c].dataType.simpleString()}" for c in key)
    place = pa.list_(pa.list_(pa.list_(pa.float64())))

    def rings_of(value: list) -> list[Ring]:
        rings = [[(float(p[0]), float(p[1])) for p in r] for r in value or [] if r]
        return [r[:-1] if len(r) > 1 and r[0] == r[-1] else r for r in rings]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                own = [b[c].slice(at, 1) for c in key]
                for piece in split(rings_of(b["rings"][at].as_py()), tile * size):
                    yield pa.RecordBatch.from_arrays([*own, pa.array([[[[x, y] for x, y in r] for r in piece]], place)], [*key, "rings"])

    def clipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                found = list(shared(rings_of(b["rings"][at].as_py()), size))
                own = [b[c].take(pa.array([at] * len(found), pa.int64())) for c in key]
                columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*own, *columns], [*key, "_q", "_r", "_area"])

    parts = polygons.select(*key, F.col("rings").cast("array<array<array<double>>>").alias("rings")).where("rings is not null")
    parts = parts.mapInArrow(pieces, f"{kinds}, rings array<array<array<double>>>").repartition(F.xxhash64("rings"))
    areas = parts.mapInArrow(clipped, f"{kinds}, _q long, _r long, _area double")
    summed = areas.groupBy(*key, "_q", "_r").agg(F.sum("_area").alias("area")).where(F.col("area") > LEAST_SHARE * 1.5 * 3**0.5 * size * size)
    return summed.select(*key, hex_id(F.col("_q"), F.col("_r")).alias("cell"), "area")
