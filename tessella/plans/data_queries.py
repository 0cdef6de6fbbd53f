"""Sinks, incremental loads, contracts and the read API."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans import contracts as C
from tessella.plans import frames as P
from tessella.plans import serve as V
from tessella.plans.registry import Registry
from tessella.sources import incremental, upsert
from tessella.session import table

query = Registry()


@query(
    "upsert_merge",
    "with o as (select c_custkey, c_nationkey as a, c_mktsegment as b from customer where c_custkey % 3 <> 0), n as (select c_custkey, case when c_custkey % 4 <> 0 then c_nationkey + 100 end as a, c_custkey * 2 as c from customer where c_custkey % 2 = 0) select coalesce(o.c_custkey, n.c_custkey) as c_custkey, case when n.c_custkey is not null then n.a else o.a end::int as a, b, c from o full join n on o.c_custkey = n.c_custkey",
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplied null overwrites; a column that the batch lacks stays; a new column is added."""
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("b"))
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey") + 100).alias("a"), (F.col("c_custkey") * 2).alias("c"))
    return upsert.merge(old, new, ["c_custkey"])


@query("update_from", "select c_custkey, case when c_nationkey < 5 then 'N' || r_name else c_mktsegment end as c_mktsegment from customer left join (select n_nationkey, r_name from nation join region on r_regionkey = n_regionkey) r on n_nationkey = c_nationkey")
def update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).where("n_nationkey < 5").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("N"), "r_name").alias("c_mktsegment"))
    return upsert.update_from(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), names, ["c_nationkey"]).drop("c_nationkey")


@query("delete_before", "select o_orderkey from orders where o_orderdate::date >= date '1998-01-01'")
def delete_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return upsert.delete_before(orders, "d", "1998-01-01").drop("d")


@query("incremental_window", "with h as (select max(o_orderdate::date) as m from orders where o_orderdate < date '2000-01-01') select o_orderkey from orders, h where o_orderdate::date between m + 1 - 14 and date '2000-06-30'")
def incremental_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run loads on top of a table that ends in 1999, with 14 days again for late rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    window = incremental.window_to_load(orders.where("d < date'2000-01-01'"), "d", dt.date(1995, 1, 1), dt.date(2000, 6, 30), overlap_days=14)
    return orders.where(F.col("d").between(*window)).drop("d")


@query("json_rows", "select c_custkey, '{\"c_custkey\":' || c_custkey || ',\"c_nationkey\":' || c_nationkey || case when c_custkey % 5 <> 0 then ',\"v\":' || c_custkey else '' end || '}' as json from customer")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("v"))
    return upsert.to_json_rows(c).select(F.get_json_object("json", "$.c_custkey").cast("long").alias("c_custkey"), "json")


@query("geojson_points", "select '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || s_suppkey % 180 || '.0,' || s_suppkey % 90 || '.5]},\"properties\":{\"s_suppkey\":' || s_suppkey || '}}' as json from supplier")
def geojson_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 90 + 0.5).cast("double").alias("lat"), (F.col("s_suppkey") % 180).cast("double").alias("lon"))
    return upsert.to_geojson_rows(s, "lat", "lon")


@query("gap_check", "with d as (select distinct o_custkey, date_trunc('week', o_orderdate)::date as date from orders) select o_custkey, date, next_date, (next_date - date)::int as days from (select o_custkey, date, lead(date) over (partition by o_custkey order by date) as next_date from d) x where next_date - date > 7")
def gap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = table(spark, sf_dir, "orders").select("o_custkey", F.trunc("o_orderdate", "week").alias("date"))
    return C.gaps(weeks, "date", 7, ("o_custkey",))


@query("step_alignment", f"with {P.ORDER_FLOW_SQL} select count(distinct date) as n_dates, floor((max(date) - min(date)) / 14.0 + 1)::bigint as n_expected, count(distinct date) = floor((max(date) - min(date)) / 14.0 + 1)::bigint as aligned from fl")
def step_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.alignment(P.order_flow(spark, sf_dir), "date", P.DAYS)


@query("prevalence", f"with {P.ORDER_PANEL_SQL} select 'prevalence of v' as \"check\", avg((v > 0)::int) as found, avg((v > 0)::int) > 0.00001 as passed from op")
def prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prevalence(P.order_panel(spark, sf_dir), "v", 1e-5)


@query(
    "contract_checks",
    "select 'no null in l_quantity' as \"check\", 0.0::double as found, true as passed union all select 'l_quantity within 1 and 40', count(*) filter (l_quantity not between 1 and 40)::double, count(*) filter (l_quantity not between 1 and 40) = 0 from lineitem union all select 'unique l_orderkey, l_linenumber', count(*) filter (n > 1)::double, count(*) filter (n > 1) = 0 from (select count(*) as n from lineitem group by l_orderkey, l_linenumber) x union all select 'no decimals in l_linenumber', 0.0::double, true",
)
def contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return C.all_checks([C.no_nulls(lines, "l_quantity"), C.in_range(lines, "l_quantity", 1, 40), C.unique_key(lines, ["l_orderkey", "l_linenumber"]), C.float_like_integers(lines, "l_linenumber")])


@query("null_report", f"with {P.EVENT_PANEL_SQL}, r as (select avg((v is null)::int::double) as r from ep) select 'v' as \"column\", r as observed, 0.5::double as expected, case when abs(r - 0.5) <= 0.05 then 'ok' when r < 0.5 then 'low' else 'high' end as status from r union all select 'date', 0.0::double, 0.02::double, 'ok'")
def null_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.null_report(P.event_panel(spark, sf_dir), {"v": 0.5, "date": 0.02})


@query("score_range", "select 'l_discount' as \"column\", min(l_discount) as low, max(l_discount) as high, false as all_zero from lineitem union all select 'l_tax', min(l_tax), max(l_tax), false from lineitem")
def score_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.score_range(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"])


# Predictions for the read API: the newest customers stand for cells, their orders' priority for horizons.
_PRED = f"""{P.ORDER_EVENTS_SQL}, pr as (select cell, date_trunc('month', d)::date as date, case when o_custkey % 2 = 0 then '14d' else '1m' end as horizon, (count(*) % 10) / 10.0::double as prob, (sum(v) % 1000)::double as predicted, (sum(v) % 1000)::double / 2 as lower, (sum(v) % 1000)::double * 2 as upper from oe group by 1, 2, 3),
sx as (select n_nationkey::bigint as cell, r_name as unit from nation join region on r_regionkey = n_regionkey)"""


def _pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = P.order_events(spark, sf_dir).groupBy("cell", F.trunc("d", "month").alias("date"), F.when(F.col("o_custkey") % 2 == 0, "14d").otherwise("1m").alias("horizon"))
    sums = by.agg((F.count("*") % 10 / 10.0).alias("prob"), (F.sum("v") % 1000).cast("double").alias("predicted"))
    return sums.withColumns({"lower": F.col("predicted") / 2, "upper": F.col("predicted") * 2})


def _static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").cast("long").alias("cell"), F.col("r_name").alias("unit"))


@query("serve_dates", f"with {_PRED} select distinct date from pr where horizon = '1m'")
def serve_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.dates(_pred(spark, sf_dir), horizon="1m")


@query("serve_predictions_h3", f"with {_PRED} select cell, date, round(prob * predicted, 6) as expected, upper - lower as width, date + 28 as forecast_date from pr where horizon = '1m' and date = (select max(date) from pr where horizon = '1m')")
def serve_predictions_h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.predictions(_pred(spark, sf_dir), "1m").select("cell", "date", F.round("expected", 6).alias("expected"), "width", "forecast_date")


@query("serve_predictions_region", f"with {_PRED}, p as (select pr.*, unit from pr join sx using (cell) where horizon = '14d' and date = date '1999-05-01'), u as (select unit, round(avg(prob), 6) as prob, round(avg(predicted), 6) as predicted, round(sum(prob * predicted), 6) as expected, round(sum(lower), 6) as lower, round(sum(upper), 6) as upper from p group by unit) select p.cell, u.* from p join u using (unit)")
def serve_predictions_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    served = V.predictions_by_unit(_pred(spark, sf_dir), _static(spark, sf_dir), "unit", "14d", "1999-05-01")
    return served.withColumns({c: F.round(c, 6) for c in ("prob", "predicted", "expected", "lower", "upper")})


@query("serve_cube", f"with {_PRED} select cell, date, predicted from pr where horizon = '14d' and date > (select max(date) from pr where horizon = '14d') - interval 24 month")
def serve_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.prediction_cube(_pred(spark, sf_dir), "14d", 2).select("cell", "date", "predicted")


@query("serve_feature", f"with {P.EVENT_PANEL_SQL}, d as (select max(date) as date from ep where v is not null) select case when cell % 3 = 0 then 'a' else 'b' end as unit, case when count(v) / count(*) >= 0.3 then avg(v) end as v, count(v) as n_values, count(*) as n_rows from ep join d using (date) group by 1")
def serve_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = P.event_panel(spark, sf_dir)
    static = panel.select("cell").distinct().withColumn("unit", F.when(F.col("cell") % 3 == 0, "a").otherwise("b"))
    return V.feature(panel, "v", static=static, unit="unit", threshold=0.3)


@query("serve_history", f"with {_PRED} select date, prob, round(prob - lag(prob) over (order by date), 6) as change from pr where cell = 7 and horizon = '14d'")
def serve_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.history(_pred(spark, sf_dir), 7, "14d").select("date", "prob", F.round("change", 6).alias("change"))


@query("serve_unit_series", f"with {P.ORDER_PANEL_SQL} select date, r_name as unit, avg(v) as mean_v, sum(v)::bigint as sum_v, quantile_cont(v, 0.5) as median_v from op join nation on n_nationkey = cell join region on r_regionkey = n_regionkey group by 1, 2")
def serve_unit_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.unit_series(P.order_panel(spark, sf_dir), _static(spark, sf_dir), "unit", "v")


@query("serve_summary", f"with {P.ORDER_PANEL_SQL}, r as (select date, r_name, sum(v)::bigint as v from op join nation on n_nationkey = cell join region on r_regionkey = n_regionkey group by all) select date, max(v) as max_v, min(v) as min_v, avg(v) as mean_v from r group by date")
def serve_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.summary(P.order_panel(spark, sf_dir), _static(spark, sf_dir), "unit", "v")


@query("serve_events", f"with {P.ORDER_EVENTS_SQL} select o_orderkey, v, d from oe where d >= date '2000-01-01' order by v desc, o_orderkey limit 500")
def serve_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.events(P.order_events(spark, sf_dir).select("o_orderkey", "v", "d"), [F.desc("v"), F.col("o_orderkey")], 500, "2000-01-01", "d")


@query("serve_parent", "select r_name as unit from nation join region on r_regionkey = n_regionkey where n_nationkey = 3 limit 1")
def serve_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.parent_unit(_static(spark, sf_dir), "cell", "unit", 3)


@query(
    "serve_explanations",
    "with x as (select o_custkey as cell, date_trunc('year', o_orderdate)::date as date, o_orderpriority as feature, sum(o_orderkey % 13 - 6)::bigint as value from orders group by all), l as (select * from x where (cell, date) in (select cell, max(date) from x group by cell)), r as (select *, row_number() over (partition by cell order by abs(value) desc, feature) as k from l) select cell, date, string_agg(feature || ':' || value, ',' order by k) as top from r where k <= 3 group by cell, date",
)
def serve_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cell"), F.trunc("o_orderdate", "year").alias("date"), F.col("o_orderpriority").alias("feature")).agg(F.sum(F.col("o_orderkey") % 13 - 6).alias("value"))
    return V.explanations(long).select("cell", "date", F.array_join(F.transform("top", lambda s: F.concat_ws(":", s["feature"], s["value"])), ",").alias("top"))


QUERIES, ORACLE_SQL = query.queries, query.oracle
