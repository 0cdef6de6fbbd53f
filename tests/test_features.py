"""The feature families on a small panel of two cells and eight steps."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella.operators.spine import spine, steps
from tessella.plans import features as P

GRID = P.Grid("2024-01-06", 14, 8)


def day(i):
    return dt.date(2024, 1, 6) + dt.timedelta(days=14 * i)


@pytest.fixture(scope="module")
def panel(spark):
    cells = spark.createDataFrame([(1,), (2,)], "cell long")
    return spine(cells, steps(spark, GRID.anchor, "2024-04-13", 14)).cache()


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(1, 2), (2, 1)], "cell long, neighbour long")


def series(df, c, cell=1):
    return [None if r[c] is None else round(float(r[c]), 4) for r in df.where(F.col("cell") == cell).orderBy("date").collect()]


def test_event_counts(spark, panel):
    events = spark.createDataFrame([(1, day(0), "battle", 2), (1, day(1), "riot", 1), (2, day(2), "battle", 5), (2, day(20), "battle", 9)], "cell long, date date, kind string, fatalities int")
    units = spark.createDataFrame([(1, "a"), (2, "a")], "cell long, unit string")
    df = P.event_counts(panel, events, GRID, {"battles": ["battle"]}, units)
    assert series(df, "fatalities") == [0, 3, 0, 0, 0, 0, 0, 0]
    assert series(df, "battles_lag1") == [0, 0, 1, 0, 0, 0, 0, 0]
    assert series(df, "unit_fatalities_lag1") == [0, 0, 3, 5, 0, 0, 0, 0] == series(df, "unit_fatalities_lag1", 2)


def test_mechanisms(spark, panel):
    scored = spark.createDataFrame([(1, day(1), 0.5, 0.2), (1, day(1) + dt.timedelta(days=3), 0.25, 0.9)], "cell long, date date, score double, risk double")
    df = P.mechanisms(panel, scored, GRID, ["score", "risk"])
    assert series(df, "score") == [0, 0, 0.75, 0, 0, 0, 0, 0] and series(df, "risk")[2] == 0.9
    assert series(df, "score_lag1")[3] == 0.75


def test_news(spark, panel, edges):
    long = spark.createDataFrame([(1, day(1), "count", 4.0), (1, day(0) + dt.timedelta(days=5), "count", 2.0), (2, day(1), "tone", -3.0)], "cell long, date date, variable string, value double")
    df = P.news(panel, long, GRID, ["count", "tone"], edges, "2024-02-01", "count", "tone")
    assert series(df, "count") == [0, 3, 0, 0, 0, 0, 0, 0]
    assert series(df, "count_ring1", 2)[1] == 3 and series(df, "tone_ring1")[1] == -3
    assert series(df, "count_rolling")[:3] == [0, 1.5, 1]
    assert series(df, "national_count_decay_30d")[:2] == series(df, "count_decay_30d")[:2]
    assert series(df, "news_available") == [0, 0, 1, 1, 1, 1, 1, 1]


def test_outages(spark, panel):
    s = int(dt.datetime(2024, 2, 4, tzinfo=dt.timezone.utc).timestamp())
    df = P.outages(panel, spark.createDataFrame([(1, s, s, 7.0)], "cell long, start long, end long, score double"), GRID, "2024-01-01")
    assert series(df, "outage_score") == [0, 0, 7, 0, 0, 0, 0, 0]


def test_report_pillars(spark, panel, edges):
    scores = spark.createDataFrame([(1, day(0), 10, 0.5), (1, day(0), 11, 1.0)], "cell long, date date, topic int, score double")
    velocity = spark.createDataFrame([(day(0), 0.5)], "date date, velocity double")
    df = P.report_pillars(panel, scores, velocity, GRID, {10: "x", 11: "y"}, {"x": 0.4, "y": 0.6}, edges)
    assert series(df, "x") == [0, 0, 0.5, 0.5, 0.5, 0, 0, 0]
    assert series(df, "report_score")[2] == 0.8 and series(df, "report_delta")[2:6] == [0.8, 0, 0, -0.8]
    assert series(df, "velocity_lag1") == [0, 0, 0, 0.5, 0, 0, 0, 0]
    assert series(df, "report_score_ring1", 2)[2] == 0.8


def test_macro(spark, panel):
    gold = spark.createDataFrame([(day(1), 10.0), (day(2), 20.0)], "date date, gold double")
    oil = spark.createDataFrame([(day(1) - dt.timedelta(days=3), 5.0)], "date date, oil double")
    df = P.macro(panel, [gold, oil], ["gold", "oil"], "2024-02-01")
    assert series(df, "gold_lag1") == [10, 10, 10, 20, 20, 20, 20, 20]
    assert series(P.macro(panel, [gold, oil], ["gold", "oil"], "2024-02-01", strict=True), "gold_lag1")[:3] == [None, None, 10]
    assert series(df, "macro_available") == [0, 0, 1, 1, 1, 1, 1, 1]
    assert series(P.macro(panel, None, ["gold"], "2024-02-01"), "gold_lag1") == [None] * 8


def test_local_prices(spark, panel):
    prices = spark.createDataFrame([(7, day(1), "maize", 10.0), (7, day(3), "maize", 30.0), (8, day(1), "rice", 5.0)], "market int, date date, good string, value double")
    cells = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "cell long, lat double, lon double")
    markets = spark.createDataFrame([(7, 1.0, 1.0), (8, 8.0, 8.0)], "market int, plat double, plon double")
    df = P.local_prices(panel, prices, cells, markets, ["maize", "rice"], "2024-01-01")
    assert series(df, "price_maize") == [None, 10, 10, 30, 30, 30, 30, 30]
    assert series(df, "price_maize_shock")[:4] == [None, 1, 1, 1.8]
    assert series(df, "price_index", 2)[1] == 5 and series(df, "price_maize_recency")[1:5] == [0, 14, 0, 14]
    assert series(df, "price_available") == [0, 1, 1, 1, 1, 1, 1, 1]


def test_displacement_and_population(spark, panel):
    df = P.displacement(panel, spark.createDataFrame([(1, day(0), 50.0)], "cell long, date date, displaced double"), GRID, "2024-01-01")
    assert series(df, "displaced_lag1") == [50, 50, 50, 50, 50, 50, 50, 50]
    assert series(df, "displaced_recency")[:5] == [None, None, 0, 14, 28]
    df = P.population(panel, spark.createDataFrame([(1, 2024, 99.0)], "cell long, year int, population double"), 2024)
    assert series(df, "population_log")[0] == round(4.60517, 4) and series(df, "population_log", 2)[0] is None


def test_stocks_of_the_environment(spark, panel):
    measures = spark.createDataFrame([(1, day(i), float(i)) for i in (0, 1, 2)], "cell long, date date, rain double")
    df = P.climate(panel, measures, {"rain": True}, 2020)
    assert series(df, "rain") == [0, 1, 2, 2, 2, None, None, None]
    lights = spark.createDataFrame([(1, day(1), 3.0, 2.0, 1.0), (1, day(2), 3.0, 9.0, 1.0)], "cell long, date date, light_mean double, light_peak double, light_trust double")
    df = P.nightlights(panel, lights, "2024-01-01")
    assert series(df, "light_delta")[:4] == [None, 0, 6, None] and series(df, "light_stale_days")[1:3] == [0, 14]
    df = P.land_cover(panel, spark.createDataFrame([(1, day(1), 0.5)], "cell long, date date, trees double"), ["trees"], "2024-01-01")
    assert series(df, "land_cover_available") == [0, 1, 1, 1, 0, 0, 0, 0]


def test_ethnicity(spark, panel):
    groups = spark.createDataFrame([(1, "MONOPOLY", 2020, 2024), (2, "POWERLESS", 2024, 2030), (3, "IRRELEVANT", 2000, 2030)], "group int, status string, first_year int, last_year int")
    bridge = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "group int, cell long")
    df = P.ethnicity(panel, groups, bridge)
    assert series(df, "group_count")[0] == 2 and series(df, "excluded_count")[0] == 1 and series(df, "status_mean")[0] == -0.5
    assert series(df, "status_mean", 2)[0] == -2


def test_distances_season_and_fusion(spark, panel):
    cells = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "cell long, lat double, lon double")
    points = spark.createDataFrame([(1, 0.0, 1.0)], "point int, plat double, plon double")
    df = P.distances(cells, {"road": points}, {"capital": (0.0, 0.0)})
    row = df.where("cell = 1").first()
    assert row["dist_capital"] == 0 and round(row["dist_road"], 1) == 111.2
    assert series(P.season(panel), "is_dry_season")[0] == 1
    small = spark.createDataFrame([(1, 2.0, None, -3.0, 4.0)], "cell int, a double, b double, d double, tone double")
    row = P.fusion(small, {"ab": ("a", "b")}, "d", "a", "tone", ["a", "b"]).first()
    assert (row["ab"], row["escalation_momentum"], row["shock_signal"]) == (0, 0, -6)


def test_the_panel_is_the_same_twice(spark, panel, edges):
    long = spark.createDataFrame([(1, day(i % 8), "count", float(i)) for i in range(30)], "cell long, date date, variable string, value double")
    build = lambda p: sorted(map(str, P.season(P.news(p, long.repartition(5), GRID, ["count"], edges, "2024-01-01", "count", "tone")).collect()))
    assert build(panel) == build(panel.repartition(3))
