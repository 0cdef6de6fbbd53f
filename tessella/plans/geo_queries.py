"""Polygons on the hexagon grid, derived from the customers of each nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.geo import hex_q, hex_r
from tessella.operators import joins as J
from tessella.operators import polygons as G
from tessella.operators.terrain import terrain
from tessella.plans import frames as P
from tessella.plans.registry import Registry
from tessella.session import table

query = Registry()
SIZE = 0.5
WIDTH = SIZE * 3**0.5
#: Directions of an outline's corners, against the clock.
WAYS = [(4, 0), (3, 2), (2, 3), (0, 4), (-2, 3), (-3, 2), (-4, 0), (-3, -2), (-2, -3), (0, -4), (2, -3), (3, -2)]


def nation_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, rings: an outline of twelve corners around each nation's place, as far out as the balances of a twelfth of its customers say, with a hole in it."""
    sums = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n"), F.pmod("c_custkey", F.lit(12)).cast("int").alias("k")).agg(F.pmod(F.sum(P.cents("c_acctbal")), F.lit(64)).alias("v"))
    ways = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for k, (x, y) in enumerate(WAYS)])).alias("w")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("name"), ways).select("n", "name", "w.*")
    reach = (F.coalesce("v", F.lit(0)) + 32) / 128
    corners = nations.join(sums, ["n", "k"], "left").select("n", "name", "k", (F.col("dx") * reach).alias("x"), (F.col("dy") * reach).alias("y"))
    outlines = corners.groupBy("n", "name").agg(F.sort_array(F.collect_list(F.struct("k", "x", "y"))).alias("c"))
    east, north = F.col("n") % 5 * 3, F.expr("n div 5") * 3
    ring = lambda scale: F.transform("c", lambda c: F.array(c["x"] * scale + east, c["y"] * scale + north))
    return outlines.select("name", F.array(ring(1.0), F.reverse(ring(0.25))).alias("rings"))


_EDGES = f"""
    s as (select c_nationkey as n, c_custkey % 12 as k, ((sum(round(c_acctbal * 100)::bigint) % 64) + 64) % 64 as v from customer group by all),
    w(k, dx, dy) as (values {", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(WAYS))}),
    c as (select n_nationkey as n, n_name as name, w.k, dx * (coalesce(v, 0) + 32) / 128.0::double as x, dy * (coalesce(v, 0) + 32) / 128.0::double as y from nation cross join w left join s on s.n = n_nationkey and s.k = w.k),
    g as (select a.name, f.scale, f.turn, a.x * f.scale + a.n % 5 * 3 as ax, a.y * f.scale + a.n // 5 * 3 as ay, b.x * f.scale + b.n % 5 * 3 as tx, b.y * f.scale + b.n // 5 * 3 as ty
      from c a join c b on a.n = b.n and b.k = (a.k + 1) % 12 cross join (values (1.0::double, 1), (0.25::double, -1)) f(scale, turn)),
    e as (select name, case when ay < ty then turn else -turn end as sign, case when ay < ty then ax else tx end as x1, least(ay, ty) as y1, case when ay < ty then tx else ax end as x2, greatest(ay, ty) as y2 from g where ay <> ty),
    h as (select q, r, (q + r / 2.0::double) * {WIDTH!r}::double as lon, r * {1.5 * SIZE!r}::double as lat from (select unnest(range(-30, 45)) as q) cross join (select unnest(range(-6, 24)) as r))"""


@query("polygon_cells", f"with {_EDGES} select name, q::bigint as q, r::bigint as r from e join h on y1 <= lat and lat < y2 and x1 + (lat - y1) * (x2 - x1) / (y2 - y1) <= lon group by all having count(*) % 2 = 1")
def polygon_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose centre is in a nation's polygon and not in its hole."""
    cells = G.cells_of_polygons(nation_polygons(spark, sf_dir), SIZE, ["name"])
    return cells.select("name", hex_q(F.col("cell")).alias("q"), hex_r(F.col("cell")).alias("r"))


_OVERLAPS = f"""{_EDGES},
    f(sign, x1, y1, x2, y2) as (values {", ".join(f"({s}, {s * x1!r}::double, {y1!r}::double, {s * x2!r}::double, {y2!r}::double)" for s in (1, -1) for x1, y1, x2, y2 in ((0.0, -SIZE, WIDTH / 2, -SIZE / 2), (WIDTH / 2, -SIZE / 2, WIDTH / 2, SIZE / 2), (WIDTH / 2, SIZE / 2, 0.0, SIZE)))}),
    p as (select name, q, r, e.sign * f.sign as sign, greatest(e.y1, lat + f.y1) as a, least(e.y2, lat + f.y2) as b, e.x1 - lon as ex1, e.y1 as ey1, (e.x2 - e.x1) / (e.y2 - e.y1) as es, f.x1 as fx1, lat + f.y1 as fy1, (f.x2 - f.x1) / (f.y2 - f.y1) as fs
      from e join h on e.y1 < lat + {SIZE!r} and e.y2 > lat - {SIZE!r} and abs(e.x1 - lon) < 9 cross join f where greatest(e.y1, lat + f.y1) < least(e.y2, lat + f.y2)),
    m as (select *, ex1 + (a - ey1) * es as ea, ex1 + (b - ey1) * es as eb, fx1 + (a - fy1) * fs as fa, fx1 + (b - fy1) * fs as fb from p),
    i as (select name, q, r, sign * case when (ea <= fa and eb <= fb) then (ea + eb) / 2 * (b - a) when (ea >= fa and eb >= fb) then (fa + fb) / 2 * (b - a)
        else (b - a) * ((ea - fa) / ((ea - fa) - (eb - fb)) * (least(ea, fa) + ea + (ea - fa) / ((ea - fa) - (eb - fb)) * (eb - ea)) / 2
          + (1 - (ea - fa) / ((ea - fa) - (eb - fb))) * (least(eb, fb) + ea + (ea - fa) / ((ea - fa) - (eb - fb)) * (eb - ea)) / 2) end as part from m),
    o as (select name, q, r, sum(part) as area from i group by all having sum(part) > 1e-7)"""


@query("polygon_overlaps", f"with {_OVERLAPS} select name, count(*)::bigint as cells, round(sum(round(area, 8)), 4) as area from o group by name")
def polygon_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells each nation's polygon shares area with, and the whole area. The SQL integrates over pairs of edges instead of clipping."""
    shared = G.polygon_overlaps(nation_polygons(spark, sf_dir), SIZE, ["name"], tile=4).where("area > 1e-7")
    return shared.groupBy("name").agg(F.count("*").alias("cells"), F.round(F.sum(F.round("area", 8)), 4).alias("area"))


@query("polygon_largest_overlap", f"with {_OVERLAPS} select q::bigint as q, r::bigint as r, arg_min(name, (-round(area, 6), name)) as name, round(max(area), 6) as area from o group by q, r")
def polygon_largest_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's nation: the one that shares most of its area."""
    shared = G.polygon_overlaps(nation_polygons(spark, sf_dir), SIZE, ["name"], tile=4).where("area > 1e-7").withColumn("area", F.round("area", 6))
    best = J.largest_overlap(shared, "cell", "name", "area").join(shared, ["cell", "name"])
    return best.select(hex_q(F.col("cell")).alias("q"), hex_r(F.col("cell")).alias("r"), "name", "area")


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel table of line items: rows of 30 orders, columns by part; the value is the quantity sold, -1 (no data) for a multiple of 17."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey div 30").alias("row"), F.pmod("l_partkey", F.lit(40)).alias("col")).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    return sold.select("row", "col", F.when(F.col("v") % 17 == 0, -1.0).otherwise(F.col("v").cast("double")).alias("value"))


_NEAR = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
_ALL = [(i, j) for i in range(3) for j in range(3)]
_TERRAIN = f"""
    p as (select l_orderkey // 30 as row, l_partkey % 40 as col, case when sum(l_quantity::bigint) % 17 <> 0 then sum(l_quantity::bigint)::double end as value from lineitem group by all),
    x as (select min(row) as r0, max(row) as r1, min(col) as c0, max(col) as c1 from p),
    a as (select p.row, p.col, p.value as a11, p.row = r0 as north, p.row = r1 as south, p.col = c0 as west, p.col = c1 as east, {", ".join(f"n{i + 1}{j + 1}.value as a{i + 1}{j + 1}" for i, j in _NEAR)}
      from p cross join x {" ".join(f"left join p n{i + 1}{j + 1} on n{i + 1}{j + 1}.row = p.row + {i} and n{i + 1}{j + 1}.col = p.col + {j}" for i, j in _NEAR)}),
    b as (select *, {", ".join(f"a{i}1 as b{i}1, case when west and (north or south) then a{i}1 when west then 2 * a{i}1 - a{i}2 else a{i}0 end as b{i}0, case when east and (north or south) then a{i}1 when east then 2 * a{i}1 - a{i}0 else a{i}2 end as b{i}2" for i in range(3))} from a),
    d as (select *, {", ".join(f"coalesce(b1{j}, a11) as d1{j}, coalesce(case when north then 2 * b1{j} - b2{j} else b0{j} end, a11) as d0{j}, coalesce(case when south then 2 * b1{j} - b0{j} else b2{j} end, a11) as d2{j}" for j in range(3))} from b),
    t as (select row, col, a11 as value, case when a11 is not null then degrees(atan(sqrt(pow(d00 + 2 * d10 + d20 - d02 - 2 * d12 - d22, 2) + pow(d20 + 2 * d21 + d22 - d00 - 2 * d01 - d02, 2)) / 800)) end as slope, sqrt({" + ".join(f"pow(d{i}{j} - a11, 2)" for i, j in _ALL)}) as ruggedness from d)"""


@query("terrain_slope", f"with {_TERRAIN} select row, col, round(slope, 6) as slope, round(ruggedness, 6) as ruggedness from t")
def terrain_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope and ruggedness of each pixel. The SQL joins each pixel with its eight neighbours instead of dealing tiles."""
    found = terrain(heights(spark, sf_dir), nodata=-1.0, scale=100.0)
    return found.select("row", "col", F.round("slope", 6).alias("slope"), F.round("ruggedness", 6).alias("ruggedness"))


@query("terrain_by_cell", f"with {_TERRAIN} select row // 16 as cell, round(avg(value), 6) as elevation, round(avg(slope), 6) as slope, round(avg(ruggedness), 6) as ruggedness from t group by all")
def terrain_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of height, slope and ruggedness over the valid pixels of each cell of sixteen rows."""
    found = terrain(heights(spark, sf_dir), nodata=-1.0, scale=100.0)
    return found.groupBy(F.expr("row div 16").alias("cell")).agg(*[F.round(F.avg(c), 6).alias(n) for c, n in (("value", "elevation"), ("slope", "slope"), ("ruggedness", "ruggedness"))])


QUERIES, ORACLE_SQL = query.queries, query.oracle
