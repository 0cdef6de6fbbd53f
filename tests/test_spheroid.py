"""Distances on the spheroid against published lines."""

import pytest
from pyspark.sql import functions as F

from tessella.functions.geo import haversine_km, spheroid_km


def dms(d, m, s):
    return (abs(d) + m / 60 + s / 3600) * (-1 if d < 0 else 1)


# Ends and kilometres: a published test line of a national survey; a quarter of the equator and of the meridian; half a
# meridian (points opposite on the equator); a nearly opposite pair whose length is published with a geodesic library.
LINES = [
    (dms(-37, 57, 3.72030), dms(144, 25, 29.52440), dms(-37, 39, 10.15610), dms(143, 55, 35.38390), 54.972271),
    (0.0, 0.0, 0.0, 90.0, 10018.754171),
    (0.0, 20.0, 90.0, -70.0, 10001.965729),
    (0.0, 0.0, 0.0, 180.0, 20003.931459),
    (30.0, 10.0, -30.0, -170.0, 20003.931459),
    (-41.32, 174.81, 40.96, -5.50, 19959.679267),
    (12.5, 7.25, 12.5, 7.25, 0.0),
    (10.0, 179.9, 10.0, -179.9, None),
]


def test_published_lines(spark):
    df = spark.createDataFrame([(i, *line[:4]) for i, line in enumerate(LINES)], "i int, a double, b double, c double, d double")
    there, back = spheroid_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")), spheroid_km(F.col("c"), F.col("d"), F.col("a"), F.col("b"))
    got = {r["i"]: (r["there"], r["back"], r["sphere"]) for r in df.select("i", there.alias("there"), back.alias("back"), haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("sphere")).collect()}
    for i, line in enumerate(LINES):
        assert got[i][0] == pytest.approx(got[i][1], abs=1e-6)
        assert got[i][0] == pytest.approx(got[i][2], rel=6e-3)
        if line[4] is not None:
            assert got[i][0] == pytest.approx(line[4], abs=1e-6), line


def test_nulls_and_whole_numbers(spark):
    df = spark.sql("select * from values (1, 2, 3, null), (0, 0, 0, 90) as t(a, b, c, d)")
    got = [r[0] for r in df.select(spheroid_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got[0] is None and got[1] == pytest.approx(10018.754171, abs=1e-6)
