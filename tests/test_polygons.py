"""Polygons against shapes whose cells and areas are known, and against even-odd counting."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import geo
from tessella.operators import joins, polygons
from tessella.sources import readers

SCHEMA = "name string, rings array<array<array<double>>>"
CELL = 1.5 * 3**0.5  # area of a cell of side 1


def star(n, seed, cx=0.0, cy=0.0, far=9.0):
    rng = random.Random(seed)
    reach = [rng.uniform(min(3, far / 2), far) for _ in range(n)]
    return [[cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)] for k, r in enumerate(reach)]


def ring_area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (x1, y1) != (x2, y2) and (y1 <= y < y2 or y2 <= y < y1):
                (x1, y1), (x2, y2) = sorted([(x1, y1), (x2, y2)], key=lambda p: p[1])
                odd ^= x1 + (y - y1) * (x2 - x1) / (y2 - y1) <= x
    return odd


def with_qr(df):
    return {(*[r[c] for c in df.columns if c not in ("cell", "area")], r["q"], r["r"]): r for r in df.withColumns({"q": geo.hex_q(F.col("cell")), "r": geo.hex_r(F.col("cell"))}).collect()}


def test_centres_in_polygons(spark):
    shapes = {"star": [star(40, 1), star(9, 2, far=3.5)[::-1]], "closed": [star(7, 3) + star(7, 3)[:1]], "level": [[[-3.0, 0.0], [4.0, 0.0], [4.0, 1.5], [-3.0, 1.5]]], "line": [[[0.0, 0.0], [5.0, 5.0]]], "point": [[[0.0, 0.0]]], "empty": [], "none": None}
    found = with_qr(polygons.cells_of_polygons(spark.createDataFrame(list(shapes.items()), SCHEMA), 1.0, ["name"]))
    w = 3**0.5
    expected = {(n, q, r) for n, rings in shapes.items() for q in range(-20, 21) for r in range(-12, 13) if rings and inside(rings, (q + r / 2) * w, r * 1.5)}
    assert set(found) == expected and {n for n, *_ in expected} == {"star", "closed", "level"}


def test_parts_share_a_name_and_borders_belong_to_one(spark):
    w = 3**0.5
    west = [[-6 * w, -9.0], [0.0, -9.0], [0.0, 9.0], [-6 * w, 9.0]]  # the border runs through centres
    east = [[0.0, -9.0], [6 * w, -9.0], [6 * w, 9.0], [0.0, 9.0]]
    df = spark.createDataFrame([("two", [west]), ("two", [east])], SCHEMA)
    cells = [r["cell"] for r in polygons.cells_of_polygons(df, 1.0, ["name"]).collect()]
    assert len(cells) == len(set(cells)) == 12 * 12
    apart = spark.createDataFrame([("w", [west]), ("e", [east])], SCHEMA)
    assert sorted(r["cell"] for r in polygons.cells_of_polygons(apart, 1.0, ["name"]).collect()) == sorted(cells)


@pytest.mark.parametrize("tile", [1, 3, 100])
def test_areas_add_up_and_do_not_depend_on_tiles(spark, tile):
    outline, hole = star(30, 4), [[0.3 * x, 0.3 * y] for x, y in star(30, 4)]
    shapes = [("a", [outline, hole[::-1]]), ("b", [outline[::-1]]), ("c", [hole + hole[:1]]), ("null", None), ("flat", [[[0.0, 0.0], [1.0, 1.0]]])]
    found = polygons.polygon_overlaps(spark.createDataFrame(shapes, SCHEMA), 1.0, ["name"], tile=tile)
    sums = {r["name"]: r["a"] for r in found.groupBy("name").agg(F.sum("area").alias("a")).collect()}
    assert sums == pytest.approx({"a": ring_area(outline) - ring_area(hole), "b": ring_area(outline), "c": ring_area(hole)})
    assert found.where(F.col("area") > CELL * (1 + 1e-9)).isEmpty()


def test_known_overlaps(spark):
    w = 3**0.5
    half = [[0.0, -5.0], [9.0, -5.0], [9.0, 5.0], [0.0, 5.0]]  # from the middle of cell (0, 0) to the east
    found = with_qr(polygons.polygon_overlaps(spark.createDataFrame([("h", [half])], SCHEMA), 1.0, ["name"]))
    assert found["h", 0, 0]["area"] == pytest.approx(CELL / 2) and found["h", 1, 0]["area"] == pytest.approx(CELL)
    assert ("h", -1, 0) not in found
    touching = [[w / 2, -1.0], [5.0, -1.0], [5.0, 1.0], [w / 2, 1.0]]  # touches cell (0, 0) along its side
    assert ("t", 0, 0) not in with_qr(polygons.polygon_overlaps(spark.createDataFrame([("t", [touching])], SCHEMA), 1.0, ["name"]))


def test_largest_overlap_wins(spark):
    near, far = [[-0.2, -5.0], [9.0, -5.0], [9.0, 5.0], [-0.2, 5.0]], [[-9.0, -5.0], [-0.2, -5.0], [-0.2, 5.0], [-9.0, 5.0]]
    bridge = polygons.polygon_overlaps(spark.createDataFrame([("near", [near]), ("far", [far])], SCHEMA), 1.0, ["name"])
    best = with_qr(joins.largest_overlap(bridge, "cell", "name", "area"))
    assert ("near", 0, 0) in best and ("far", -1, 0) in best and len({k[1:] for k in best}) == len(best)


def test_boundary_and_centre(spark):
    cells = spark.createDataFrame([(0, 0), (3, -2), (-4, 5)], "q long, r long").select(geo.hex_id(F.col("q"), F.col("r")).alias("cell"))
    for r in cells.select(geo.hex_centre(F.col("cell"), 2.0).alias("c"), geo.hex_boundary(F.col("cell"), 2.0).alias("b"), "cell", geo.hex_of_point(geo.hex_centre(F.col("cell"), 2.0)["lat"], geo.hex_centre(F.col("cell"), 2.0)["lon"], 2.0).alias("again")).collect():
        assert ring_area([list(p) for p in r["b"]]) == pytest.approx(4 * CELL) and r["again"] == r["cell"]
        assert all(math.hypot(x - r["c"]["lon"], y - r["c"]["lat"]) == pytest.approx(2) for x, y in r["b"])


def test_geojson(spark, tmp_path):
    square = lambda x: [[[x, 0], [x + 2, 0], [x + 2, 2], [x, 2], [x, 0]]]
    features = [
        {"type": "Feature", "properties": {"name": "one"}, "geometry": {"type": "Polygon", "coordinates": square(0)}},
        {"type": "Feature", "properties": {"name": "two", "more": 1}, "geometry": {"type": "MultiPolygon", "coordinates": [square(4), square(8.5)]}},
        {"type": "Feature", "properties": {"name": "p"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": {"name": "none"}, "geometry": None},
    ]
    (tmp_path / "all.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, features)))
    whole = readers.read_geojson_polygons(spark, str(tmp_path / "all.json"), ["name"])
    assert sorted((r["name"], r["part"], r["rings"][0][0][0]) for r in whole.collect()) == [("one", 0, 0.0), ("two", 0, 4.0), ("two", 1, 8.5)]
    lines = readers.read_geojson_polygons(spark, str(tmp_path / "lines.json"), ["name"], lines=True)
    assert sorted(map(repr, lines.collect())) == sorted(map(repr, whole.collect()))
    sums = polygons.polygon_overlaps(whole, 0.5, ["name"]).groupBy("name").agg(F.sum("area").alias("a")).collect()
    assert {r["name"]: r["a"] for r in sums} == pytest.approx({"one": 4.0, "two": 8.0})


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert polygons.cells_of_polygons(none, 1.0, ["name"]).isEmpty() and polygons.polygon_overlaps(none, 1.0, ["name"]).isEmpty()
