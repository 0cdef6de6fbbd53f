"""Hand-made frames for the edge rules of bins, fills, lags, recency, decay and ranks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella.operators import binning, decay, joins, windows

D0 = dt.date(2024, 1, 6)
ONE = [None, 5, None, None, None, 7, 7]
TWO = [3, None, 4, None, None, None, None]


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(cell, D0 + dt.timedelta(days=14 * i), None if v is None else float(v)) for cell, vs in ((1, ONE), (2, TWO)) for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "cell long, date date, v double").repartition(3)


def column(df, c):
    return {cell: [None if r[c] is None else round(r[c], 4) for r in sorted((r for r in df.collect() if r["cell"] == cell), key=lambda r: r["date"])] for cell in (1, 2)}


def test_fill_and_lags(panel):
    w = windows.over_cell()
    df = windows.lag_back_fill(panel.withColumn("ff2", windows.forward_fill("v", w, 2)), "v", "lag_b", w)
    assert column(df, "ff2") == {1: [None, 5, 5, 5, None, 7, 7], 2: [3, 3, 4, 4, 4, None, None]}
    assert column(df, "lag_b") == {1: [5, 5, 5, 7, 7, 7, 7], 2: [3, 3, 4, 4, None, None, None]}
    assert column(windows.lag_back_fill(panel, "v", "s", w, strict=True), "s")[1] == [None, None, 5, None, None, None, 7]


def test_lead_targets(panel):
    df = windows.lead_targets(panel, "v", {"2": 2}, windows.over_cell())
    assert column(df, "target_2")[1] == [None, None, None, 7, 7, None, None]
    assert column(df, "target_2_binary")[2] == [1, None, None, None, None, None, None]


@pytest.mark.parametrize("form", ["fold", "window"])
def test_decay(panel, form):
    df = decay.decay_fold(panel, "v", "y", 0.5) if form == "fold" else decay.decay_window(panel, "v", "y", 0.5, windows.over_cell(), 7)
    assert column(df, "y") == {1: [0, 2.5, 1.25, 0.625, 0.3125, 3.6562, 5.3281], 2: [3, 1.5, 2.75, 1.375, 0.6875, 0.3438, 0.1719]}


def test_decay_window_refuses_long_series():
    with pytest.raises(ValueError):
        decay.decay_window(None, "v", "y", 0.5, None, 2000)


def test_shock_and_recency(panel):
    w = windows.over_cell()
    assert column(panel.withColumn("s", windows.shock("v", w, 3)), "s") == {1: [None, 1.0, None, None, None, 1.0, 1.0], 2: [1.0, None, 1.1429, None, None, None, None]}
    df = windows.recency(panel.withColumn("f", windows.forward_fill("v", w, 2)), "f", "rec")
    assert column(df, "rec") == {1: [None, 0, 14, 28, None, 0, 14], 2: [0, 14, 0, 14, 28, None, None]}


@pytest.mark.parametrize("lowest", [False, True])
def test_right_closed_bins(spark, lowest):
    days = [dt.date(2024, 1, 5), D0, dt.date(2024, 1, 7), dt.date(2024, 1, 20), dt.date(2024, 1, 21), dt.date(2024, 2, 17), dt.date(2024, 2, 18)]
    df = spark.createDataFrame([(d,) for d in days], "d date").withColumn("step", binning.bin_right_closed(F.col("d"), "2024-01-06", 14, 4, lowest))
    second, third, fourth = dt.date(2024, 1, 20), dt.date(2024, 2, 3), dt.date(2024, 2, 17)
    assert {r["d"]: r["step"] for r in df.collect()} == dict(zip(days, [None, second if lowest else None, second, second, third, fourth, None]))


def test_asof_tolerance_and_nulls(spark):
    left = spark.createDataFrame([(dt.date(2024, 1, 6),), (dt.date(2024, 1, 20),), (dt.date(2024, 2, 3),)], "date date")
    a = spark.createDataFrame([(dt.date(2024, 1, 6), 1)], "date date, p int")
    b = spark.createDataFrame([(dt.date(2024, 1, 6), 1, 9), (dt.date(2024, 1, 19), None, 8)], "date date, p int, q int")
    got = lambda right: [tuple(r)[1:] for r in joins.asof_backward(left, right, "date", tolerance_days=14).orderBy("date").collect()]
    assert got(a) == [(1,), (1,), (None,)]
    assert got(b) == [(1, 9), (None, 8), (None, None)]


def test_percent_rank_and_tiers(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate((5, 5, 3, 1, 1, 1))], "g int, i int, v int").withColumn("s", windows.average_percent_rank("v", "g"))
    got = [(round(r["s"], 4), r["t"]) for r in df.withColumn("t", windows.tier(F.col("s"))).orderBy("i").collect()]
    assert got == [(0.25, "3_elevated")] * 2 + [(0.5, "4_baseline")] + [(0.8333, "4_baseline")] * 3


def test_seasonal_z_without_baseline_uses_all(spark):
    df = spark.createDataFrame([(1, dt.date(y, 1, 1), float(y)) for y in (2021, 2022, 2023)], "cell int, date date, v double")
    z = [r["z"] for r in windows.seasonal_z(df, "v", "z", 2000).orderBy("date").collect()]
    assert [round(x, 3) for x in z] == [-1, 0, 1]


def test_group_total_of_null_group_is_zero(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 3), (None, 1, 7)], "g string, date int, v int").withColumn("t", joins.group_total("v", "g", "date"))
    assert sorted((r["v"], r["t"]) for r in df.collect()) == [(2, 5), (3, 5), (7, 0)]


def test_one_shuffle_serves_all_windows(panel):
    w = windows.over_cell()
    df = panel.withColumns({"a": windows.lag_zero("v", w), "b": windows.rolling_mean("v", w, 6), "c": windows.forward_fill("v", w, 4)})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_decay_of_a_long_series_equals_the_recursion(spark):
    begin, alpha = dt.date(1600, 1, 1), decay.alpha_of(3.0)
    values = [(i, float((i * 7919) % 101) if i % 5 else None) for i in range(100_000) if not 40_000 < i < 70_000]
    rows = [(1, begin + dt.timedelta(days=i), v) for i, v in values] + [(2, begin, 3.0), (None, begin, 1.0), (None, begin + dt.timedelta(days=9_000), 2.0)]
    got = {(r["cell"], r["date"]): r["y"] for r in decay.decay_fold(spark.createDataFrame(rows, "cell int, date date, v double").repartition(4), "v", "y", alpha).collect()}
    y = None
    for i, v in values:
        y = (v or 0.0) if y is None else alpha * (v or 0.0) + (1 - alpha) * y
        assert got[1, begin + dt.timedelta(days=i)] == pytest.approx(y, rel=1e-12, abs=1e-300)
    assert got[2, begin] == pytest.approx(3.0) and got[None, begin + dt.timedelta(days=9_000)] == pytest.approx(alpha * 2 + (1 - alpha)) and len(got) == len(rows)
