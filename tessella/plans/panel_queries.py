"""Spine, binning, windows and joins on the panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import binning as B
from tessella.operators import decay as D
from tessella.operators import joins as J
from tessella.operators import spatial as X
from tessella.operators import spine as S
from tessella.operators import windows as W
from tessella.plans import frames as P
from tessella.plans.registry import Registry
from tessella.session import table

query = Registry()
CELL = "partition by cell order by date"


@query(
    "flagship_tiers",
    f"""with {P.ORDER_PANEL_SQL},
    l as (select op.cell, op.date, n_regionkey, coalesce(lag(v) over ({CELL}), 0)::bigint as lag_v from op join nation on n_nationkey = cell),
    r as (select *, sum(lag_v) over (partition by n_regionkey, date)::bigint as region_v from l),
    k as (select *, (rank() over (partition by date order by lag_v desc) + (count(*) over (partition by date, lag_v) - 1) / 2.0) / count(*) over (partition by date) as share from r)
    select cell, date, lag_v, region_v, share::double as share, case when share <= 0.05 then '1_critical' when share <= 0.15 then '2_high' when share <= 0.3 then '3_elevated' else '4_baseline' end as tier from k""",
)
def flagship_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = P.order_panel(spark, sf_dir).withColumn("lag_v", W.lag_zero("v", W.over_cell()))
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("cell"), "n_regionkey")
    panel = panel.join(regions, "cell").withColumn("region_v", J.group_total("lag_v", "n_regionkey", "date"))
    return panel.withColumn("share", W.average_percent_rank("lag_v", "date")).select("cell", "date", "lag_v", "region_v", "share", W.tier(F.col("share")).alias("tier"))


@query(
    "spine_cross",
    f"""with {P.STEPS_SQL}, e as (select date, dense_rank() over (partition by year(date) order by date)::bigint as epoch from st)
    select n_nationkey::bigint as cell, date, epoch, round(sin(2 * pi() * month(date) / 12), 9) as month_sin, round(cos(2 * pi() * month(date) / 12), 9) as month_cos,
      (month(date) in (11, 12, 1, 2, 3, 4))::int as is_dry_season from nation cross join e""",
)
def spine_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = S.with_epoch(S.steps(spark, P.ANCHOR, P.END, P.DAYS)).withColumn("epoch", F.col("epoch").cast("long"))
    dates = dates.withColumns(S.seasonality(F.col("date")))
    return S.spine(P.nations(spark, sf_dir), dates.withColumns({c: F.round(c, 9) for c in ("month_sin", "month_cos")}))


def _binned(spark: SparkSession, sf_dir: str, label) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", label(F.col("o_orderdate").cast("date")).alias("step"))
    return orders.groupBy("step").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


_RIGHT = "select case when i between 1 and {n} then date '1995-02-05' + i * 14 end as step, count(*) as n, min(o_orderkey) as first_key from (select o_orderkey, {i} as i from (select o_orderkey, o_orderdate::date as d, ceil((o_orderdate::date - date '1995-02-05') / 14.0)::int as j from orders) a) b group by 1"


@query("bin_right_closed", _RIGHT.format(n=99, i="j"))
def bin_right_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binned(spark, sf_dir, lambda d: B.bin_right_closed(d, "1995-02-05", 14, 100))


@query("bin_right_closed_incl", _RIGHT.format(n=99, i="case when d = date '1995-02-05' then 1 else j end"))
def bin_right_closed_incl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binned(spark, sf_dir, lambda d: B.bin_right_closed(d, "1995-02-05", 14, 100, include_lowest=True))


@query("snap_left_closed", "select date '1995-02-05' + floor((o_orderdate::date - date '1995-02-05' + 28) / 14.0)::int * 14 as step, count(*) as n, min(o_orderkey) as first_key from orders group by 1")
def snap_left_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binned(spark, sf_dir, lambda d: B.snap_left_closed(d, "1995-02-05", 14, 28))


@query("aligned_windows", "with w as (select w::date as window_start, least(w::date + 13, date '2001-12-20') as window_end from (select unnest(generate_series(date '1996-01-14', date '2001-12-20', interval 14 day)) as w) x) select window_start, window_end, count(o_orderkey) as orders from w left join orders on o_orderdate::date between window_start and window_end group by 1, 2")
def aligned_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each window: dates are placed on the grid, so windows are met by their start."""
    day = F.col("o_orderdate").cast("date")
    counts = table(spark, sf_dir, "orders").where(day <= F.lit("2001-12-20").cast("date")).groupBy(B.snap_left_closed(day, P.ANCHOR, 14).alias("window_start")).agg(F.count("*").alias("orders"))
    windows = B.aligned_windows(spark, P.ANCHOR, "1996-01-10", "2001-12-20", 14)
    return windows.join(counts, "window_start", "left").select("window_start", "window_end", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("flow_zero_fill", f"with {P.ORDER_PANEL_SQL} select * from op")
def flow_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.order_panel(spark, sf_dir)


@query("publication_lag", f"with {P.ORDER_FLOW_SQL} select st.date, coalesce(sum(fl.v), 0)::bigint as v from st left join fl on fl.date + 28 = st.date group by 1")
def publication_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = P.order_flow(spark, sf_dir).groupBy(B.publication_lag(F.col("date"), 2, P.DAYS).alias("date")).agg(F.sum("v").alias("v"))
    return J.dense_left_join(S.steps(spark, P.ANCHOR, P.END, P.DAYS), late, ["date"], ["v"])


@query(
    "lags",
    f"""with {P.EVENT_PANEL_SQL}, l as (select *, lag(v) over ({CELL}) as lag_null from ep),
    b as (select *, first_value(lag_null ignore nulls) over ({CELL} rows between current row and unbounded following) as lag_filled from l)
    select cell, date, coalesce(lag_null, 0)::bigint as lag_zero, lag_null, lag_filled, coalesce(lag_filled, 0)::bigint as lag_filled_zero, v - lag_null as diff from b""",
)
def lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.over_cell()
    df = P.event_panel(spark, sf_dir).withColumns({"lag_zero": W.lag_zero("v", w), "lag_null": W.lag_null("v", w), "diff": W.difference("v", w)})
    df = W.lag_back_fill(W.lag_back_fill(df, "v", "lag_filled", w), "v", "lag_filled_zero", w, default=0)
    return df.select("cell", "date", "lag_zero", "lag_null", "lag_filled", "lag_filled_zero", "diff")


@query(
    "national_lag_broadcast",
    f"""with {P.ORDER_PANEL_SQL}, n as (select date, lag(s) over (order by date) as l from (select date, sum(v)::bigint as s from op group by date) x),
    f as (select date, first_value(l ignore nulls) over (order by date rows between current row and unbounded following) as national_lag from n) select cell, op.date, national_lag from op join f using (date)""",
)
def national_lag_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.national_lag(P.order_panel(spark, sf_dir), "v", "national_lag").select("cell", "date", "national_lag")


@query(
    "lead_targets",
    f"""with {P.ORDER_PANEL_SQL}, t as (select cell, date, lead(v, 1) over ({CELL}) as target_14d, lead(v, 6) over ({CELL}) as target_3m from op)
    select cell, date, target_14d, (target_14d > 0)::int as target_14d_binary, target_3m, (target_3m > 0)::int as target_3m_binary from t where target_14d is not null and target_3m is not null""",
)
def lead_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = W.lead_targets(P.order_panel(spark, sf_dir), "v", {"14d": 1, "3m": 6}, W.over_cell())
    return df.dropna(subset=["target_14d", "target_3m"]).drop("v")


@query(
    "forward_fills",
    f"""with {P.EVENT_PANEL_SQL} select cell, date, last_value(v ignore nulls) over ({CELL} rows between 2 preceding and current row) as fill_2, last_value(v ignore nulls) over ({CELL} rows between 4 preceding and current row) as fill_4,
    last_value(v ignore nulls) over ({CELL} rows between unbounded preceding and current row) as fill_all from ep""",
)
def forward_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.over_cell()
    return P.event_panel(spark, sf_dir).select("cell", "date", W.forward_fill("v", w, 2).alias("fill_2"), W.forward_fill("v", w, 4).alias("fill_4"), W.forward_fill("v", w).alias("fill_all"))


@query(
    "recency_days",
    f"""with {P.EVENT_PANEL_SQL}, f as (select cell, date, last_value(v ignore nulls) over ({CELL} rows between 2 preceding and current row) as v from ep),
    l as (select *, lag(v) over ({CELL}) as b from f), c as (select *, case when v is not null and (b is null or b <> v) then date end as changed from l),
    m as (select *, last_value(changed ignore nulls) over ({CELL} rows between unbounded preceding and current row) as since from c)
    select cell, date, case when v is not null then (date - since)::int end as recency from m""",
)
def recency_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = P.event_panel(spark, sf_dir).withColumn("v", W.forward_fill("v", W.over_cell(), 2))
    return W.recency(df, "v", "recency").select("cell", "date", "recency")


_DECAY = f"""with {P.EVENT_PANEL_SQL}, i as (select cell, date, coalesce(v, 0) / 100.0 as x, row_number() over ({CELL}) - 1 as k from ep),
p as (select cell, date, k, case when k = 0 then x else x * {{a!r}} * pow(1 - {{a!r}}, -k) end as part from i)
select cell, date, round(pow(1 - {{a!r}}, k) * sum(part) over ({CELL} rows between unbounded preceding and current row), 6) as decayed from p"""


@query("ewm_30d", _DECAY.format(a=D.alpha_of(30 / 14)))
def ewm_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = P.event_panel(spark, sf_dir).withColumn("x", F.col("v") / 100)
    return D.decay_fold(df, "x", "decayed", D.alpha_of(30 / 14)).select("cell", "date", F.round("decayed", 6).alias("decayed"))


@query("ewm_14d", _DECAY.format(a=0.5).replace("coalesce(v, 0) / 100.0", "coalesce(v, 0)::double").replace("round(", "(").replace(", 6)", ")"))
def ewm_14d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A half-life of one step: halves of whole cents are exact, so nothing is rounded."""
    return D.decay_fold(P.event_panel(spark, sf_dir), "v", "decayed", 0.5).select("cell", "date", "decayed")


@query("ewm_window", _DECAY.format(a=D.alpha_of(30 / 14)))
def ewm_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = P.event_panel(spark, sf_dir).withColumn("x", F.col("v") / 100)
    return D.decay_window(df, "x", "decayed", D.alpha_of(30 / 14), W.over_cell(), 30).select("cell", "date", F.round("decayed", 6).alias("decayed"))


@query(
    "national_sum_decay",
    f"""with {P.EVENT_PANEL_SQL}, n as (select date, sum(coalesce(v, 0)) / 1e6 as x, row_number() over (order by date) - 1 as k from ep group by date),
    p as (select date, k, case when k = 0 then x else x * {D.alpha_of(2.14)!r} * pow(1 - {D.alpha_of(2.14)!r}, -k) end as part from n)
    select date, round(pow(1 - {D.alpha_of(2.14)!r}, k) * sum(part) over (order by date rows between unbounded preceding and current row), 6) as decayed from p""",
)
def national_sum_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    national = P.event_panel(spark, sf_dir).groupBy("date").agg((F.sum(F.coalesce("v", F.lit(0))) / 1e6).alias("x")).withColumn("cell", F.lit(0))
    return D.decay_fold(national, "x", "decayed", D.alpha_of(2.14)).select("date", F.round("decayed", 6).alias("decayed"))


_LINES = "li as (select l_suppkey as cell, date_trunc('month', l_shipdate)::date as date, avg(l_quantity) as q from lineitem group by all)"


def _line_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.trunc("l_shipdate", "month").alias("date")).agg(F.avg("l_quantity").alias("q"))


@query("rolling_shock_26", f"with {_LINES} select cell, date, round(q / (avg(q) over ({CELL} rows between 25 preceding and current row) + 1e-6), 6) as shock, round(avg(q) over ({CELL} rows between 5 preceding and current row), 6) as mean_6 from li")
def rolling_shock_26(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.over_cell()
    return _line_months(spark, sf_dir).select("cell", "date", F.round(W.shock("q", w, 26), 6).alias("shock"), F.round(W.rolling_mean("q", w, 6), 6).alias("mean_6"))


@query(
    "seasonal_zscore",
    f"""with {_LINES}, b as (select *, case when year(date) <= 1998 then q end as base from li),
    z as (select cell, date, (q - avg(base) over (partition by cell, month(date))) / (stddev_samp(base) over (partition by cell, month(date)) + 1e-6) as z from b)
    select cell, date, round(z, 6) as z, round(avg(z) over ({CELL} rows between 5 preceding and current row), 6) as z_6 from z""",
)
def seasonal_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = W.seasonal_z(_line_months(spark, sf_dir), "q", "z", 1998)
    return df.select("cell", "date", F.round("z", 6).alias("z"), F.round(W.rolling_mean("z", W.over_cell(), 6), 6).alias("z_6"))


@query(
    "pct_rank_tier",
    """with k as (select c_custkey, (rank() over (partition by c_nationkey order by round(c_acctbal) desc) + (count(*) over (partition by c_nationkey, round(c_acctbal)) - 1) / 2.0) / count(*) over (partition by c_nationkey) as share from customer)
    select c_custkey, share::double as share, case when share <= 0.05 then '1_critical' when share <= 0.15 then '2_high' when share <= 0.3 then '3_elevated' else '4_baseline' end as tier, share <= 0.05 as is_priority from k""",
)
def pct_rank_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").withColumn("score", F.round("c_acctbal")).withColumn("share", W.average_percent_rank("score", "c_nationkey"))
    tier = W.tier(F.col("share"))
    return df.select("c_custkey", "share", tier.alias("tier"), (tier == "1_critical").alias("is_priority"))


@query("regional_sum_join_back", f"with {P.ORDER_PANEL_SQL} select cell, date, v, sum(v) over (partition by n_regionkey, date)::bigint as region_v, round(ln(1 + v), 9) as log_v from op join nation on n_nationkey = cell")
def regional_sum_join_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("cell"), "n_regionkey")
    return P.order_panel(spark, sf_dir).join(regions, "cell").select("cell", "date", "v", J.group_total("v", "n_regionkey", "date").alias("region_v"), F.round(F.log1p("v"), 9).alias("log_v"))


@query("availability_flag", f"with {P.EVENT_PANEL_SQL} select cell, date, (date >= date '2024-01-10' and v is not null)::int as available from ep")
def availability_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.event_panel(spark, sf_dir).select("cell", "date", W.availability_flag(F.col("date"), "2024-01-10", ["v"]).alias("available"))


_SERIES = "se as (select l_shipdate::date as date, max(l_quantity) as p, case when day(l_shipdate::date) % 3 = 0 then null else count(*) end as q from lineitem group by 1)"


@query(
    "asof_backward_tol",
    f"""with {P.STEPS_SQL}, {_SERIES}, m as (select st.date, se.date as seen, se.p, se.q from st asof left join se on st.date >= se.date)
    select n_nationkey::bigint as cell, date, case when date - seen <= 14 then p end as p, case when date - seen <= 14 then q end as q from m cross join nation""",
)
def asof_backward_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("date", F.col("l_shipdate").cast("date"))
    series = lines.groupBy("date").agg(F.max("l_quantity").alias("p"), F.count("*").alias("q")).withColumn("q", F.when(F.day("date") % 3 != 0, F.col("q")))
    return J.asof_backward(S.spine(P.nations(spark, sf_dir), S.steps(spark, P.ANCHOR, P.END, P.DAYS)), series, "date", tolerance_days=14)


@query(
    "asof_by_key",
    """with o as (select o_custkey, o_orderdate::date as d, max(o_orderkey) as k from orders group by all), c as (select distinct o_custkey, d + 40 as q from o)
    select c.o_custkey, c.q as d, case when c.q - o.d <= 90 then o.k end as k from c asof left join o on c.o_custkey = o.o_custkey and c.q >= o.d""",
)
def asof_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("d")).agg(F.max("o_orderkey").alias("k"))
    asked = orders.select("o_custkey", F.date_add("d", 40).alias("d")).distinct()
    return J.asof_backward(asked, orders, "d", ["o_custkey"], 90)


@query(
    "interval_overlap_weighted",
    """with e as (select user_id, floor(epoch(ts))::bigint as s, floor(epoch(ts))::bigint + (event_id % 5) * 200000 as t, round(value * 100)::bigint as v from events),
    x as (select *, floor((s - 1704067200) / 259200.0)::bigint as a, case when t > s then ceil((t - 1704067200) / 259200.0)::bigint - 1 else floor((s - 1704067200) / 259200.0)::bigint end as b from e),
    w as (select *, unnest(range(a, greatest(a, b) + 1)) as k from x)
    select user_id, date '2024-01-01' + (k * 3)::int as window_start, round(sum(v / 1e4 * case when t = s then 1.0 else (least(t, 1704067200 + (k + 1) * 259200) - greatest(s, 1704067200 + k * 259200)) / (t - s)::double end), 6) as value from w group by 1, 2""",
)
def interval_overlap_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("s"), (F.unix_timestamp("ts") + F.col("event_id") % 5 * 200_000).alias("t"), (P.cents("value") / 1e4).alias("v"))
    return J.overlap_windows(events, "s", "t", "v", "2024-01-01", 3, "user_id").withColumn("value", F.round("value", 6))


@query(
    "full_outer_series",
    """with a as (select ts::date as date, count(*) as clicks from events where event_type = 'click' and day(ts) <= 12 group by 1), b as (select ts::date as date, count(*) as errors from events where event_type = 'error' and day(ts) >= 9 group by 1),
    c as (select ts::date as date, count(*) as views from events where event_type = 'view' and day(ts) % 4 = 0 group by 1) select date, clicks, errors, views from a full join b using (date) full join c using (date)""",
)
def full_outer_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("date"), "event_type")
    one = lambda kind, days, name: events.where((F.col("event_type") == kind) & days).groupBy("date").agg(F.count("*").alias(name))
    day = F.day("date")
    return J.full_outer_series([one("click", day <= 12, "clicks"), one("error", day >= 9, "errors"), one("view", day % 4 == 0, "views")])


_POINTS = "c as (select c_custkey, (c_custkey * 37 % 180) - 90 as lat, (c_custkey * 91 % 360) - 180 as lon from customer), p as (select s_suppkey, (s_suppkey * 53 % 180) - 90 as plat, (s_suppkey * 71 % 360) - 180 as plon, s_nationkey from supplier)"
_NEAREST = f"with {_POINTS}, n as (select c_custkey, lat, lon, min((sqrt((lat - plat) ** 2 + (lon - plon) ** 2), s_suppkey, plat, plon)) as b from c cross join p group by all)"


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cells = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 180 - 90).cast("double").alias("lat"), (F.col("c_custkey") * 91 % 360 - 180).cast("double").alias("lon"))
    points = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 53 % 180 - 90).cast("double").alias("plat"), (F.col("s_suppkey") * 71 % 360 - 180).cast("double").alias("plon"))
    return cells, points


@query("nearest_point", f"{_NEAREST} select c_custkey, b[2] as s_suppkey, round(b[1] * 111, 6) as degrees_km from n")
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.nearest_point(*_points(spark, sf_dir), "c_custkey", "s_suppkey")
    return found.select("c_custkey", "s_suppkey", F.round("degrees_km", 6).alias("degrees_km"))


@query(
    "nearest_planar_then_geodesic",
    f"""{_NEAREST} select c_custkey, b[2] as s_suppkey, round(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(b[3] - lat) / 2), 2) + cos(radians(lat)) * cos(radians(b[3])) * pow(sin(radians(b[4] - lon) / 2), 2)))), 6) as geodesic_km,
    round(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(4.36 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(4.36)) * pow(sin(radians(18.56 - lon) / 2), 2)))), 6) as capital_km from n""",
)
def nearest_planar_then_geodesic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.functions.geo import haversine_km

    cells, points = _points(spark, sf_dir)
    found = X.nearest_point(cells, points, "c_custkey", "s_suppkey", limit=0)
    capital = haversine_km(F.col("lat"), F.col("lon"), F.lit(4.36), F.lit(18.56))
    return found.join(cells, "c_custkey").select("c_custkey", "s_suppkey", F.round("geodesic_km", 6).alias("geodesic_km"), F.round(capital, 6).alias("capital_km"))


_FLAT = "(1 / 298.257223563::double)"
_ARC = """*, sqrt(pow(cos(u2) * sin(x), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(x), 2)) as ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(x) as cs, atan2(ss, cs) as s,
      case when ss = 0 then 0.0::double else cos(u1) * cos(u2) * sin(x) / ss end as sa, 1 - sa * sa as ca, case when ca > 1e-15 then cs - 2 * sin(u1) * sin(u2) / ca else 0.0::double end as cm"""


@query(
    "nearest_planar_then_spheroid",
    f"""{_NEAREST.replace("with ", "with recursive ", 1)}, g as (select c_custkey, b[2] as s_suppkey, radians((b[4] - lon)::double) as l, atan((1 - {_FLAT}) * tan(radians(lat::double))) as u1, atan((1 - {_FLAT}) * tan(radians(b[3]::double))) as u2 from n),
    v(c_custkey, s_suppkey, l, u1, u2, x, i) as (select c_custkey, s_suppkey, l, u1, u2, l, 0 from g union all
      select c_custkey, s_suppkey, l, u1, u2, l + (1 - c) * {_FLAT} * sa * (s + c * ss * (cm + c * cs * (2 * cm * cm - 1))), i + 1 from (select *, {_FLAT} / 16 * ca * (4 + {_FLAT} * (4 - 3 * ca)) as c from (select {_ARC} from v where i < 15))),
    k as (select *, ca * (1 / pow(1 - {_FLAT}, 2) - 1) as u, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) as b from (select {_ARC} from v where i = 15))
    select c_custkey, s_suppkey, round(6378.137::double * (1 - {_FLAT}) * (1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))) * (s - b * ss * (cm + b / 4 * (cs * (2 * cm * cm - 1) - b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))), 3) as spheroid_km from k""",
)
def nearest_planar_then_spheroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's supplier nearest by planar degrees, with its distance on the spheroid."""
    from tessella.functions.geo import spheroid_km

    found = X.nearest_point(*_points(spark, sf_dir), "c_custkey", "s_suppkey", limit=0, km=spheroid_km)
    return found.select("c_custkey", "s_suppkey", F.round("geodesic_km", 3).alias("spheroid_km"))


@query(
    "neighbour_sum_ring1",
    f"with {P.ORDER_PANEL_SQL}, e as (select n_nationkey::bigint as cell, (n_nationkey + k + 25) % 25 as neighbour from nation cross join (select unnest([-1, 1]) as k) x), s as (select e.cell, op.date, sum(op.v)::bigint as ring from e join op on op.cell = e.neighbour group by all) select op.cell, op.date, coalesce(ring, 0)::bigint as ring from op left join s using (cell, date)",
)
def neighbour_sum_ring1(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.nations(spark, sf_dir)
    edges = cells.select("cell", F.explode(F.array(F.lit(-1), F.lit(1))).alias("k")).select("cell", ((F.col("cell") + F.col("k") + 25) % 25).alias("neighbour"))
    return J.neighbour_sum(P.order_panel(spark, sf_dir), edges, "v", "ring").select("cell", "date", "ring")


@query(
    "hex_ring_sum",
    """with p as (select distinct ((c_custkey % 40) << 32) + (c_custkey * 7 % 30) + 2147483648 as cell from customer), o as (select unnest([{'q': -1, 'r': 0}, {'q': -1, 'r': 1}, {'q': 0, 'r': -1}, {'q': 0, 'r': 1}, {'q': 1, 'r': -1}, {'q': 1, 'r': 0}]) as o)
    select p.cell, count(n.cell) as n_neighbours from p cross join o left join p n on n.cell = p.cell + (o.q::bigint * 4294967296) + o.r group by p.cell""",
)
def hex_ring_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.functions.geo import hex_id, ring_edges

    cells = table(spark, sf_dir, "customer").select(hex_id(F.col("c_custkey") % 40, F.col("c_custkey") * 7 % 30).alias("cell")).distinct().withColumns({"one": F.lit(1).cast("long"), "date": F.lit("2024-01-01").cast("date")})
    return J.neighbour_sum(cells, ring_edges(cells, "cell"), "one", "n_neighbours").select("cell", "n_neighbours")


@query(
    "pop_weighted_disagg",
    """with u as (select c_nationkey, c_custkey, case when c_custkey % 7 = 0 then null when c_nationkey % 5 = 0 then 0 else c_custkey % 11 end as pop from customer), n as (select c_nationkey, count(*) as n from orders join customer on c_custkey = o_custkey group by 1),
    s as (select u.*, n.n, sum(case when c_nationkey % 5 = 0 then 0 else coalesce(pop, 1) end) over (partition by c_nationkey) as total, count(*) over (partition by c_nationkey) as k from u join n using (c_nationkey))
    select c_custkey, round(n * case when total > 0 then case when c_nationkey % 5 = 0 then 0 else coalesce(pop, 1) end / total::double else 1.0 / k end, 9) as share from s""",
)
def pop_weighted_disagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    counts = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).groupBy("c_nationkey").agg(F.count("*").alias("n"))
    pop = F.when(F.col("c_nationkey") % 5 == 0, 0.0).when(F.col("c_custkey") % 7 == 0, None).otherwise((F.col("c_custkey") % 11).cast("double"))
    units = customers.select("c_nationkey", "c_custkey", pop.alias("pop")).join(counts, "c_nationkey")
    return X.weighted_shares(units, "c_nationkey", "n", "pop", "share").select("c_custkey", F.round("share", 9).alias("share"))


@query("largest_overlap_wins", "select c_nationkey, arg_min(c_mktsegment, (-n, c_mktsegment)) as c_mktsegment from (select c_nationkey, c_mktsegment, count(*) as n from customer group by all) x group by 1")
def largest_overlap_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bridge = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return J.largest_overlap(bridge, "c_nationkey", "c_mktsegment", "n")


@query(
    "cascade_lookup",
    """with a as (select p_brand, p_size, min(p_partkey) as v from part where p_partkey % 3 = 0 group by all), b as (select p_brand, max(p_partkey) as v from part where p_size > 45 group by all), c as (select p_size, -count(*) as v from part group by all)
    select p_partkey, coalesce(a.v, b.v, c.v)::bigint as unit from part left join a using (p_brand, p_size) left join b using (p_brand) left join c using (p_size)""",
)
def cascade_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    a = part.where("p_partkey % 3 = 0").groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("v"))
    b = part.where("p_size > 45").groupBy("p_brand").agg(F.max("p_partkey").alias("v"))
    c = part.groupBy("p_size").agg((-F.count("*")).alias("v"))
    return J.cascade_lookup(part, [(a, ["p_brand", "p_size"], "v"), (b, ["p_brand"], "v"), (c, ["p_size"], "v")], "unit").select("p_partkey", "unit")


@query(
    "substring_actor_match",
    """with k as (select n_name as k, n_nationkey + 0.5 as w, row_number() over (order by n_nationkey % 7 desc, n_name) as r from nation), a as (select distinct substr(n_name, 1, 1 + (c_custkey % 5)::int) || case when c_custkey % 4 = 0 then ' north' else '' end as name from customer join nation on n_nationkey = c_nationkey),
    m as (select name, arg_min(w, (name <> k, r)) as w from a join k on contains(name, k) or contains(k, name) group by name) select name, coalesce(w, 0)::double as weight from a left join m using (name)""",
)
def substring_actor_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    known = nation.select(F.col("n_name").alias("k"), (F.col("n_nationkey") + 0.5).cast("double").alias("w"), F.row_number().over(Window.orderBy((F.col("n_nationkey") % 7).desc(), "n_name")).alias("r"))
    customers = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    names = customers.select(F.concat(F.expr("substr(n_name, 1, 1 + cast(c_custkey % 5 as int))"), F.when(F.col("c_custkey") % 4 == 0, " north").otherwise("")).alias("name")).distinct()
    return J.substring_match(names, known, "name", "k", "w", "r")


@query("lead_time_latest", f"""with {P.EVENT_PANEL_SQL}, f as (select *, (date - date '2024-01-01')::bigint as pos from ep) select cell, date, (pos - max(case when v > 60000 then pos end) over (partition by cell order by pos range between 7 preceding and current row))::bigint as lead_time,
    (pos - min(case when v > 60000 then pos end) over (partition by cell order by pos range between 7 preceding and current row))::bigint as lead_time_earliest from f""")
def lead_time_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = W.date_positions(P.event_panel(spark, sf_dir))
    df = W.latest_lookup(df, F.col("v") > 60000, "lead_time", 7)
    return W.latest_lookup(df, F.col("v") > 60000, "lead_time_earliest", 7, earliest=True).select("cell", "date", "lead_time", "lead_time_earliest")


@query("signal_dip", f"""with {P.EVENT_PANEL_SQL}, s as (select coalesce(v, 0) as v, lag(coalesce(v, 0), 1) over ({CELL}) as v1, lag(coalesce(v, 0), 2) over ({CELL}) as v2, case when lag(coalesce(v, 0)) over ({CELL}) >= 50000 then 3 when lag(coalesce(v, 0)) over ({CELL}) >= 20000 then 2 when lag(coalesce(v, 0)) over ({CELL}) >= 1 then 1 when lag(coalesce(v, 0)) over ({CELL}) >= 0 then 0 end as bin from ep)
    select bin, count(*) as n, avg(v) as mean_t, avg(v1) as mean_t1, avg(v2) as mean_t2 from s where bin is not null group by bin""")
def signal_dip(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.over_cell()
    df = P.event_panel(spark, sf_dir).withColumn("v", F.coalesce("v", F.lit(0)))
    df = df.withColumns({"v1": F.lag("v", 1).over(w), "v2": F.lag("v", 2).over(w)}).withColumn("bin", B.value_bin(F.col("v1"), [0, 1, 20000, 50000]))
    return df.where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg("v").alias("mean_t"), F.avg("v1").alias("mean_t1"), F.avg("v2").alias("mean_t2"))


@query("offset_lookup", f"with {P.EVENT_PANEL_SQL} select a.cell, a.date, b.v as v_3 from ep a left join ep b on a.cell = b.cell and a.date = b.date + 3")
def offset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.at_offset(W.date_positions(P.event_panel(spark, sf_dir)), "v", "v_3", 3).select("cell", "date", "v_3")


QUERIES, ORACLE_SQL = query.queries, query.oracle
