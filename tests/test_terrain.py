import math
import random

import pytest

from tessella.operators.spatial import zonal
from tessella.operators.terrain import terrain

PIXELS = "row long, col long, value double"


def by_loops(pixels, scale=1.0, width=1.0, height=1.0, riley=True):
    """The stencil pixel by pixel, from the docstring."""
    r0, r1 = min(r for r, _ in pixels), max(r for r, _ in pixels)
    c0, c1 = min(c for _, c in pixels), max(c for _, c in pixels)

    def line(a, b):
        return None if a is None or b is None else 2 * a - b

    def at(r, c, corner):
        if c < c0:
            return at(r, c0, corner) if corner else line(at(r, c0, corner), at(r, c0 + 1, corner))
        if c > c1:
            return at(r, c1, corner) if corner else line(at(r, c1, corner), at(r, c1 - 1, corner))
        if r < r0:
            return line(at(r0, c, corner), at(r0 + 1, c, corner))
        if r > r1:
            return line(at(r1, c, corner), at(r1 - 1, c, corner))
        return pixels.get((r, c))

    out = {}
    for (r, c), v in pixels.items():
        if v is None:
            out[r, c] = (None, None)
            continue
        corner = r in (r0, r1)
        w = [[at(r + i, c + j, corner) for j in (-1, 0, 1)] for i in (-1, 0, 1)]
        w = [[v if x is None else x for x in row] for row in w]
        dx = (w[0][0] + 2 * w[1][0] + w[2][0] - w[0][2] - 2 * w[1][2] - w[2][2]) / width
        dy = (w[2][0] + 2 * w[2][1] + w[2][2] - w[0][0] - 2 * w[0][1] - w[0][2]) / height
        off = [x - v for row in w for x in row]
        rugged = math.sqrt(sum(x * x for x in off)) if riley else sum(map(abs, off)) / 8
        out[r, c] = (math.degrees(math.atan(math.hypot(dx, dy) / (8 * scale))), rugged)
    return out


def result(df):
    return {(r["row"], r["col"]): (r["slope"], r["ruggedness"]) for r in df.collect()}


@pytest.mark.parametrize("tile", [4, 7, 256])
@pytest.mark.parametrize("rule", ["riley", "wilson"])
def test_equal_to_loops_at_any_tile(spark, tile, rule):
    rng = random.Random(5)
    pixels = {(r, c): None if rng.random() < 0.1 else float(rng.randrange(50)) for r in range(-6, 11) for c in range(3, 22) if rng.random() < 0.95}
    rows = [(r, c, -1.0 if v is None else v) for (r, c), v in pixels.items()]
    got = result(terrain(spark.createDataFrame(rows, PIXELS), nodata=-1.0, scale=3.0, size=(0.5, 2.0), rule=rule, tile=tile))
    expected = by_loops(pixels, 3.0, 0.5, 2.0, rule == "riley")
    assert got.keys() == expected.keys() and len(got) == len(pixels)
    for k, pair in expected.items():
        assert got[k] == (None, None) if pair[0] is None else got[k] == pytest.approx(pair, abs=1e-9), k


def test_a_plane_has_one_slope(spark):
    rows = [(r, c, 2.0 * c) for r in range(9) for c in range(9)]
    got = result(terrain(spark.createDataFrame(rows, PIXELS), tile=4))
    inner = {k: v for k, v in got.items() if 0 < k[0] < 8}
    assert len(got) == 81 and all(v[0] == pytest.approx(math.degrees(math.atan(2.0))) and v[1] == pytest.approx(math.sqrt(24)) for v in inner.values())


def test_odd_inputs(spark):
    assert terrain(spark.createDataFrame([], PIXELS)).count() == 0
    rows = [(0, 0, 1.0), (0, 0, 3.0), (0, 0, None), (None, 1, 2.0), (1, None, 2.0), (5, 5, float("nan")), (5, 6, None)]
    got = {(r["row"], r["col"]): (r["value"], r["slope"]) for r in terrain(spark.createDataFrame(rows, PIXELS)).collect()}
    assert got == {(0, 0): (3.0, 0.0), (5, 5): (None, None), (5, 6): (None, None)}
    with pytest.raises(ValueError):
        terrain(spark.createDataFrame(rows, PIXELS), rule="other")


def test_zonal_means_of_slopes(spark):
    rows = [(r, c, float(r)) for r in range(4) for c in range(4)]
    cells = terrain(spark.createDataFrame(rows, PIXELS)).selectExpr("cast(floor(col / 2) as int) cell", "slope")
    got = {r["cell"]: r["zonal_mean"] for r in zonal(cells, "cell", "slope", -1.0).collect()}
    assert got == pytest.approx({0: 45.0, 1: 45.0}, rel=0.2)
