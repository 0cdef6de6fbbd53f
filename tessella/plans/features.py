"""Feature families: each takes the panel (cell, date) and its sources, and returns the panel with the family's columns.

The order within a family is lag, fill, recency, derived columns, flag; flags look at filled values. Sources that are missing
are given as None: stock columns are then null with flag 0, flow columns 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.repair import year_range
from tessella.session import materialise, small
from tessella.operators import aggregates as A
from tessella.operators import binning as B
from tessella.operators import decay as D
from tessella.operators import joins as J
from tessella.operators import spatial as X
from tessella.operators import spine as S
from tessella.operators import windows as W


@dataclass(frozen=True)
class Grid:
    """The step grid of a panel."""

    anchor: str
    days: int
    n_steps: int

    def right_closed(self, date: Column, include_lowest: bool = False) -> Column:
        return B.bin_right_closed(date, self.anchor, self.days, self.n_steps, include_lowest)

    def alpha(self, half_life_days: float) -> float:
        return D.alpha_of(half_life_days / self.days)


def stub(panel: DataFrame, stock: tuple[str, ...] = (), flow: tuple[str, ...] = ()) -> DataFrame:
    """Columns of a family whose source is missing."""
    return panel.withColumns({c: F.lit(None).cast("double") for c in stock} | {c: F.lit(0.0) for c in flow})


def decayed(panel: DataFrame, columns: list[str], grid: Grid, half_life_days: float, suffix: str) -> DataFrame:
    """Decays by window functions while the powers stay inside the double range, else by a fold."""
    w, alpha = W.over_cell(), grid.alpha(half_life_days)
    for c in columns:
        panel = D.decay_window(panel, c, f"{c}{suffix}", alpha, w, grid.n_steps) if D.fits_window(alpha, grid.n_steps) else D.decay_fold(panel, c, f"{c}{suffix}", alpha)
    return panel


def season(panel: DataFrame) -> DataFrame:
    return panel.withColumns(S.seasonality(F.col("date")))


def event_counts(panel: DataFrame, events: DataFrame | None, grid: Grid, counts: dict[str, list[str]], units: DataFrame) -> DataFrame:
    """Fatalities and counts by kind of each step, their lags, and the unit's lagged total, logged.

    events: cell, date, kind, fatalities; counts: column to the kinds that it counts; units: cell, unit.
    """
    columns = ["fatalities", *counts]
    if events is None:
        return stub(panel, flow=(*columns, "fatalities_lag1", *[f"{c}_lag1" for c in counts], "unit_fatalities_lag1", "unit_fatalities_log"))
    step = grid.right_closed(F.col("date"), include_lowest=True)
    sums = events.withColumn("date", step).where("date is not null").groupBy("cell", "date").agg(F.sum("fatalities").alias("fatalities"), *[F.count_if(F.col("kind").isin(*kinds)).alias(c) for c, kinds in counts.items()])
    w = W.over_cell()
    panel = J.dense_left_join(panel, sums, ["cell", "date"], columns)
    panel = panel.withColumns({f"{c}_lag1": W.lag_zero(c, w) for c in columns})
    panel = panel.join(units, "cell", "left").withColumn("unit_fatalities_lag1", J.group_total("fatalities_lag1", "unit", "date")).drop("unit")
    return panel.withColumn("unit_fatalities_log", F.log1p("unit_fatalities_lag1"))


def mechanisms(panel: DataFrame, scored: DataFrame | None, grid: Grid, columns: list[str], lag_days: int = 14) -> DataFrame:
    """Text scores of events by cell and step (sums, or maxima of risks), zero-filled, with their lags.

    scored: cell, date and the columns, an event a row; scores take effect lag_days later.
    """
    if scored is None:
        return stub(panel, flow=tuple(columns + [f"{c}_lag1" for c in columns]))
    snapped = scored.withColumn("date", B.snap_left_closed(F.col("date"), grid.anchor, grid.days, lag_days))
    by_step = A.by_rule(snapped, ["cell", "date"], A.rule_by_name(columns))
    by_label = by_step.withColumn("date", grid.right_closed(F.col("date"), include_lowest=True)).where("date is not null")
    means = A.by_rule(by_label, ["cell", "date"], dict.fromkeys(columns, "mean"))
    w = W.over_cell()
    return J.dense_left_join(panel, means, ["cell", "date"], columns).withColumns({f"{c}_lag1": W.lag_zero(c, w) for c in columns})


def news(panel: DataFrame, long: DataFrame | None, grid: Grid, variables: list[str], edges: DataFrame, since: str, count: str, tone: str) -> DataFrame:
    """Daily (cell, date, variable, value) news as means of a step, their ring sums, decays, rolling count, and national sums.

    The mean is over the days that have a row: zeros are not stored, so they do not lower it.
    """
    names = [v for v in variables if v != tone]
    if long is None:
        panel = stub(panel, flow=tuple(c for v in variables for c in (v, f"{v}_ring1", f"{v}_decay_30d")) + tuple(f"national_{v}_decay_30d" for v in names) + (f"{count}_rolling",))
        return panel.withColumn("news_available", (F.col("date") >= F.lit(since).cast("date")).cast("int"))
    binned = long.withColumn("date", grid.right_closed(F.col("date"))).where("date is not null")
    wide = A.pivot(binned, ["cell", "date"], "variable", variables, "value")
    for v in variables:
        wide = J.neighbour_sum(wide, edges, v, f"{v}_ring1")
    national = wide.groupBy("date").agg(*[F.sum(v).alias(f"national_{v}") for v in names])
    dates = panel.select("date").distinct().join(national, "date", "left").fillna(0.0).withColumn("cell", F.lit(0))
    dates = decayed(dates, [f"national_{v}" for v in names], grid, 30, "_decay_30d").select("date", *[f"national_{v}_decay_30d" for v in names])
    filled = [*variables, *[f"{v}_ring1" for v in variables]]
    panel = J.dense_left_join(panel.join(F.broadcast(dates), "date", "left"), wide, ["cell", "date"], filled)
    panel = decayed(panel, variables, grid, 30, "_decay_30d")
    return panel.withColumns({f"{count}_rolling": W.rolling_mean(count, W.over_cell(), 6), "news_available": (F.col("date") >= F.lit(since).cast("date")).cast("int")})


def outages(panel: DataFrame, events: DataFrame | None, grid: Grid, since: str) -> DataFrame:
    """Outage score: overlap-weighted sums of 14-day windows, the largest of a step; events: cell, start, end (seconds), score."""
    flag = (F.col("date") >= F.lit(since).cast("date")).cast("int")
    if events is None:
        return stub(panel, flow=("outage_score",)).withColumn("outage_available", flag)
    windows = J.overlap_windows(events, "start", "end", "score", grid.anchor, grid.days, "cell")
    label = grid.right_closed(F.col("window_start"))
    scores = windows.withColumn("date", label).where("date is not null").groupBy("cell", "date").agg(F.max("value").alias("outage_score"))
    return J.dense_left_join(panel, scores, ["cell", "date"], ["outage_score"]).withColumn("outage_available", flag)


def report_pillars(panel: DataFrame, scores: DataFrame | None, velocity: DataFrame, grid: Grid, topics: dict[int, str], weights: dict[str, float], edges: DataFrame, national_topic: int = 99) -> DataFrame:
    """Topic scores of reports, 28 days late, summed by step; weighted score, its change and decay; velocity and acceleration; ring sum.

    scores: cell, date, topic, score. velocity: date, velocity (national). Scores last two steps, then count 0.
    """
    pillars = list(topics.values())
    if scores is None:
        return stub(panel, flow=(*pillars, "report_score", "report_delta", "report_delta_decay_14d", "velocity_lag1", "acceleration", "report_score_ring1"))
    late = lambda df: df.withColumn("date", grid.right_closed(B.publication_lag(F.col("date"), 2, grid.days))).where("date is not null")
    local = late(scores.where(F.col("topic") != national_topic)).where(F.col("topic").isin(*topics))
    name = F.create_map(*[F.lit(x) for kv in topics.items() for x in kv])[F.col("topic")]
    wide = A.pivot(local.withColumn("topic", name), ["cell", "date"], "topic", pillars, "score", "sum")
    w = W.over_cell()
    panel = panel.join(wide, ["cell", "date"], "left").withColumns({c: F.coalesce(W.forward_fill(c, w, 2), F.lit(0.0)) for c in pillars})
    panel = panel.withColumn("report_score", A.weighted_sum(weights))
    panel = W.lag_back_fill(panel, "report_score", "report_lag1", w, default=0.0).withColumn("report_delta", F.col("report_score") - F.col("report_lag1"))
    panel = decayed(panel, ["report_delta"], grid, 14, "_decay_14d")
    v = late(velocity).groupBy("date").agg(F.avg("velocity").alias("velocity"))
    v = panel.select("date").distinct().join(v, "date", "left").fillna(0.0, ["velocity"]).withColumn("cell", F.lit(0))
    v = W.lag_back_fill(v, "velocity", "velocity_lag1", w).withColumn("acceleration", F.col("velocity") - F.col("velocity_lag1"))
    panel = panel.join(F.broadcast(v.select("date", "velocity_lag1", "acceleration")), "date", "left")
    return J.neighbour_sum(panel, edges, "report_score", "report_score_ring1")


def macro(panel: DataFrame, series: list[DataFrame] | None, columns: list[str], since: str, strict: bool = False) -> DataFrame:
    """National series as of each date (14 days at most), filled for 8 steps, lagged, with a flag. strict does not back-fill."""
    lags = [f"{c}_lag1" for c in columns]
    if series is None:
        return stub(panel, stock=tuple(lags)).withColumn("macro_available", F.lit(0))
    joined = J.asof_backward(panel, J.full_outer_series(series), "date", tolerance_days=14)
    w = W.over_cell()
    joined = joined.withColumns({c: W.forward_fill(c, w, 8) for c in columns})
    for c, lag in zip(columns, lags):
        joined = W.lag_back_fill(joined, c, lag, w, strict)
    return joined.withColumn("macro_available", W.availability_flag(F.col("date"), since, columns)).drop(*columns)


def local_prices(panel: DataFrame, prices: DataFrame | None, cells: DataFrame, markets: DataFrame, goods: list[str], since: str) -> DataFrame:
    """Prices of the nearest market: filled for 8 steps, recency, shock against 26 steps, index over goods, flag.

    prices: market, date, good, value. cells: cell, lat, lon. markets: market, plat, plon.
    """
    columns = [f"price_{g}" for g in goods]
    if prices is None:
        return stub(panel, stock=tuple(columns + [f"{c}_shock" for c in columns] + [f"{c}_recency" for c in columns] + ["price_index", "price_index_recency"])).withColumn("price_available", F.lit(0))
    wide = A.pivot(prices, ["market", "date"], "good", goods, "value").withColumnsRenamed({g: f"price_{g}" for g in goods})
    nearest = X.nearest_point(cells, markets, "cell", "market").select("cell", "market")
    w = W.over_cell()
    panel = panel.join(small(materialise(nearest)), "cell", "left").join(wide, ["market", "date"], "left").drop("market")
    panel = panel.withColumns({c: W.forward_fill(c, w, 8) for c in columns})
    for c in columns:
        panel = W.recency(panel, c, f"{c}_recency")
    panel = panel.withColumns({f"{c}_shock": W.shock(c, w, 26) for c in columns} | {"price_index": A.row_mean(columns)})
    panel = W.recency(panel, "price_index", "price_index_recency")
    return panel.withColumn("price_available", W.availability_flag(F.col("date"), since, columns))


def displacement(panel: DataFrame, dealt: DataFrame | None, grid: Grid, since: str, strict: bool = False) -> DataFrame:
    """Displaced persons (cell, date, displaced), 28 days late: filled for 12 steps, recency, lag, flag."""
    if dealt is None:
        return stub(panel, stock=("displaced_lag1", "displaced_recency")).withColumn("displaced_available", F.lit(0))
    late = dealt.withColumn("date", B.publication_lag(F.col("date"), 2, grid.days)).groupBy("cell", "date").agg(F.sum("displaced").alias("displaced"))
    w = W.over_cell()
    panel = panel.join(late, ["cell", "date"], "left").withColumn("displaced", W.forward_fill("displaced", w, 12))
    panel = W.lag_back_fill(W.recency(panel, "displaced", "displaced_recency"), "displaced", "displaced_lag1", w, strict)
    return panel.withColumn("displaced_available", W.availability_flag(F.col("date"), since, ["displaced"])).drop("displaced")


def population(panel: DataFrame, counts: DataFrame | None, new_version_year: int) -> DataFrame:
    """log1p of the year's population (cell, year, population), carried forward without limit; a flag for the newer source version."""
    flag = (F.year("date") >= new_version_year).cast("int")
    if counts is None:
        return stub(panel, stock=("population_log",)).withColumn("population_new_version", flag)
    panel = panel.withColumn("year", F.year("date")).join(counts, ["cell", "year"], "left").drop("year")
    return panel.withColumn("population_log", F.log1p(W.forward_fill("population", W.over_cell()))).withColumn("population_new_version", flag).drop("population")


def climate(panel: DataFrame, measures: DataFrame | None, columns: dict[str, bool], baseline_end_year: int) -> DataFrame:
    """Measures filled for 2 steps, and anomalies against the month; columns: name to whether the anomaly is smoothed over 6 steps."""
    if measures is None:
        return stub(panel, stock=tuple(c for m in columns for c in (m, f"{m}_anomaly")))
    w = W.over_cell()
    panel = panel.join(measures.select("cell", "date", *columns), ["cell", "date"], "left").withColumns({c: W.forward_fill(c, w, 2) for c in columns})
    for c, smooth in columns.items():
        panel = W.seasonal_z(panel, c, f"{c}_anomaly", baseline_end_year, smooth=6 if smooth else None)
    return panel


def nightlights(panel: DataFrame, lights: DataFrame | None, since: str) -> DataFrame:
    """Mean and peak light without filling, days since the mean changed, peak over mean, trust, flag; lights: cell, date, light_mean, light_peak, light_trust."""
    if lights is None:
        return stub(panel, stock=("light_mean", "light_peak", "light_trust", "light_stale_days", "light_delta")).withColumn("light_available", F.lit(0))
    panel = W.recency(panel.join(lights, ["cell", "date"], "left"), "light_mean", "light_stale_days")
    delta = F.when(F.col("light_peak").isNotNull() & F.col("light_mean").isNotNull(), F.greatest(F.col("light_peak") - F.col("light_mean"), F.lit(0.0)))
    return panel.withColumns({"light_delta": delta, "light_available": W.availability_flag(F.col("date"), since, ["light_mean"])})


def land_cover(panel: DataFrame, fractions: DataFrame | None, columns: list[str], since: str) -> DataFrame:
    if fractions is None:
        return stub(panel, stock=tuple(columns)).withColumn("land_cover_available", F.lit(0))
    w = W.over_cell()
    panel = panel.join(fractions.select("cell", "date", *columns), ["cell", "date"], "left").withColumns({c: W.forward_fill(c, w, 2) for c in columns})
    return panel.withColumn("land_cover_available", W.availability_flag(F.col("date"), since, columns))


# The two scales of a group's political status, that of the records and that of the yearly figures (others: -2), and who is excluded.
RECORD_SCALE = {"MONOPOLY": 5, "DOMINANT": 4, "SENIOR PARTNER": 3, "JUNIOR PARTNER": 2, "POWERLESS": 1, "DISCRIMINATED": 0, "SELF-EXCLUSION": -1, "IRRELEVANT": -2}
STATUS_SCALE = {"DOMINANT": 4, "SENIOR PARTNER": 3, "JUNIOR PARTNER": 2, "POWERLESS": 1, "DISCRIMINATED": 0, "SELF-EXCLUSION": 1, "IRRELEVANT": -2}
EXCLUDED = ("DISCRIMINATED", "POWERLESS")


def ethnicity(panel: DataFrame, groups: DataFrame, bridge: DataFrame, scale: dict[str, int] = STATUS_SCALE) -> DataFrame:
    """Groups of a cell and year: how many, how many excluded or discriminated, and their mean status; 0, 0, 0 and -2 without any.

    groups: group, status, first_year, last_year. bridge: group, cell. Yearly figures are aggregated before they meet the steps.
    """
    yearly = year_range(groups.where(F.col("status") != "IRRELEVANT"), "first_year", "last_year")
    score = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in scale.items() for x in kv]), F.col("status")), F.lit(-2))
    by_year = yearly.join(bridge, "group").withColumn("score", score).groupBy("cell", "year").agg(F.count_distinct("group").alias("group_count"), F.count_if(F.col("status").isin(*EXCLUDED)).alias("excluded_count"), F.count_if(F.col("status") == "DISCRIMINATED").alias("discriminated_count"), F.avg("score").alias("status_mean"))
    panel = panel.withColumn("year", F.year("date")).join(by_year, ["cell", "year"], "left").drop("year")
    return panel.fillna({"group_count": 0, "excluded_count": 0, "discriminated_count": 0, "status_mean": -2.0})


def distances(cells: DataFrame, targets: dict[str, DataFrame], fixed: dict[str, tuple[float, float]]) -> DataFrame:
    """Static table: km from each cell to the nearest of each point set (point, plat, plon) and to fixed places."""
    from tessella.functions.geo import haversine_km

    out = cells.withColumns({f"dist_{name}": haversine_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) for name, (lat, lon) in fixed.items()})
    for name, points in targets.items():
        near = X.nearest_point(cells, points, "cell", "point").select("cell", F.col("geodesic_km").alias(f"dist_{name}"))
        out = out.join(near, "cell", "left")
    return out


def fusion(panel: DataFrame, products: dict[str, tuple[str, str]], delta: str, intensity: str, tone: str, pillars: list[str]) -> DataFrame:
    """Products of two columns (0 where one is missing), the positive change times the intensity, and - tone - sum of pillars."""
    return panel.withColumns({name: A.interaction(a, b) for name, (a, b) in products.items()} | {"escalation_momentum": A.positive_part(delta, intensity), "shock_signal": -F.coalesce(F.col(tone), F.lit(0)) - A.row_sum(pillars)})
