"""Distances, nearest points and weighted disaggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.geo import haversine_km
from tessella.session import materialise, small

#: Places that every cell's place is compared with; beyond, cells look in grid squares around them.
BROADCAST_POINTS = 1_000


def nearest_point(cells: DataFrame, points: DataFrame, key: str, point: str, keep: list[str] = (), limit: int = BROADCAST_POINTS, km: Callable[..., Column] = haversine_km) -> DataFrame:
    """For each cell (key, lat, lon) the point (point, plat, plon) at the least planar distance, of equal ones the least id.

    Returns key, point, keep, planar (degrees), degrees_km (111 km a degree) and geodesic_km. The order is by planar degrees,
    so the point need not be the nearest by geodesic; `km` gives its distance (`geo.spheroid_km` on the spheroid). Points at one
    place can't differ but by id, so the least of them stands for all, and each place of cells is looked up once, however many
    cells lie there. Up to `limit` places of points (counted) are broadcast; more are met by square.
    """
    places = points.groupBy("plat", "plon").agg(F.min(F.struct(point, *keep)).alias("_p")).select("plat", "plon", "_p.*")
    spots = cells.select("lat", "lon").distinct()
    if places.limit(limit + 1).count() <= limit:
        found = _best(spots.crossJoin(F.broadcast(places)), point, keep, km)
    else:
        found = small(_nearest_by_square(materialise(spots), materialise(places), point, keep, km))
    found = found.withColumnsRenamed({"lat": "_lat", "lon": "_lon"})
    own = cells.select(key, "lat", "lon").distinct()
    return own.join(found, own["lat"].eqNullSafe(found["_lat"]) & own["lon"].eqNullSafe(found["_lon"])).select(key, point, *keep, "planar", "degrees_km", "geodesic_km")


def _best(pairs: DataFrame, point: str, keep: list[str], km: Callable[..., Column]) -> DataFrame:
    planar = F.sqrt(F.pow(F.col("lat") - F.col("plat"), 2) + F.pow(F.col("lon") - F.col("plon"), 2))
    row = F.struct(planar.alias("planar"), F.col(point), "plat", "plon", *keep)
    best = pairs.groupBy("lat", "lon").agg(F.min(row).alias("_b"))
    far = km(F.col("lat"), F.col("lon"), F.col("_b.plat"), F.col("_b.plon"))
    return best.select("lat", "lon", F.col(f"_b.{point}").alias(point), *[F.col(f"_b.{c}").alias(c) for c in keep], F.col("_b.planar").alias("planar"), (F.col("_b.planar") * 111).alias("degrees_km"), far.alias("geodesic_km"))


def _nearest_by_square(spots: DataFrame, places: DataFrame, point: str, keep: list[str], km: Callable[..., Column]) -> DataFrame:
    """Rings of grid squares, twice as wide each time, until a point is nearer than the ring's reach."""
    box = places.agg(F.min("plat"), F.max("plat"), F.min("plon"), F.max("plon"), F.count("*")).first()
    extent = max(box[1] - box[0], box[3] - box[2], 1e-9)
    side = max(extent / max(1.0, (box[4] / 4) ** 0.5), 1e-9)
    todo, done = spots, None
    limits = spots.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    whole = max(abs(a - b) for a in (*limits[:2], *box[:2]) for b in (*limits[:2], *box[:2])) + max(abs(a - b) for a in (*limits[2:], *box[2:4]) for b in (*limits[2:], *box[2:4]))
    while True:
        square = lambda c: F.floor(F.col(c) / side).cast("long")
        around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
        near = todo.withColumn("_x", F.explode(F.transform(around, lambda d: square("lat") + d))).withColumn("_y", F.explode(F.transform(around, lambda d: square("lon") + d)))
        found = materialise(_best(near.join(places.withColumns({"_x": square("plat"), "_y": square("plon")}), ["_x", "_y"]), point, keep, km))
        sure = found if side > whole else found.where(F.col("planar") <= side)
        done = sure if done is None else done.unionByName(sure)
        todo = materialise(todo.join(sure.select("lat", "lon"), ["lat", "lon"], "left_anti"))
        if side > whole or todo.isEmpty():
            return done
        side *= 2


def weighted_shares(units: DataFrame, unit: str, count: str, population: str, out: str) -> DataFrame:
    """A unit's count dealt over its cells by population: a missing one is 1, and all zero deals evenly."""
    w = Window.partitionBy(unit)
    p = F.coalesce(F.col(population), F.lit(1.0))
    total = F.sum(p).over(w)
    return units.withColumn(out, F.col(count) * F.when(total > 0, p / total).otherwise(1 / F.count("*").over(w)))


def zonal(pixels: DataFrame, cell: str, value: str, nodata: float) -> DataFrame:
    """Mean (null without valid pixels) and sum (then 0) of each cell's pixels."""
    v = F.when(F.col(value) != nodata, F.col(value))
    return pixels.groupBy(cell).agg(F.avg(v).alias("zonal_mean"), F.coalesce(F.sum(v), F.lit(0.0)).alias("zonal_sum"))
