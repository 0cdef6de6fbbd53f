"""The panels that the catalogue's queries run on, as frames and as SQL for DuckDB.

Orders are flows of nations on a 14-day grid; events are a stock of users on a 1-day grid, with gaps. Values are in cents,
so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.binning import bin_right_closed
from tessella.operators.joins import dense_left_join
from tessella.operators.spine import spine, steps
from tessella.session import table

ANCHOR, END, DAYS = "1995-01-01", "2001-12-31", 14
N_STEPS = 183
FIRST_DAY, LAST_DAY = "2024-01-01", "2024-01-30"


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"), cents("o_totalprice").alias("v"), "o_orderpriority", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("cell"))
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).drop("c_custkey")


def order_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = order_events(spark, sf_dir).withColumn("date", bin_right_closed(F.col("d"), ANCHOR, DAYS, N_STEPS))
    return events.where("date is not null").groupBy("cell", "date").agg(F.sum("v").alias("v"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("cell"))


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = spine(nations(spark, sf_dir), steps(spark, ANCHOR, END, DAYS))
    return dense_left_join(panel, order_flow(spark, sf_dir), ["cell", "date"], ["v"])


def event_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("cell"), F.col("ts").cast("date").alias("date")).agg(F.sum(cents("value")).alias("v"))


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "events").select(F.col("user_id").alias("cell")).distinct()
    return dense_left_join(spine(cells, steps(spark, FIRST_DAY, LAST_DAY, 1)), event_daily(spark, sf_dir), ["cell", "date"])


ORDER_EVENTS_SQL = "oe as (select c_nationkey::bigint as cell, o_orderdate::date as d, round(o_totalprice * 100)::bigint as v, o_custkey, o_orderkey, o_orderpriority, o_orderstatus from orders join customer on o_custkey = c_custkey)"
STEPS_SQL = f"st as (select unnest(generate_series(date '{ANCHOR}', date '{END}', interval {DAYS} day))::date as date)"
ORDER_FLOW_SQL = f"""{ORDER_EVENTS_SQL}, {STEPS_SQL},
fl as (select cell, date '{ANCHOR}' + i * {DAYS} as date, sum(v)::bigint as v from (select cell, v, ceil((d - date '{ANCHOR}') / {DAYS}.0)::int as i from oe) x
  where i between 1 and {N_STEPS - 1} group by all)"""
ORDER_PANEL_SQL = f"""{ORDER_FLOW_SQL},
op as (select n_nationkey::bigint as cell, st.date, coalesce(fl.v, 0)::bigint as v from nation cross join st left join fl on fl.cell = n_nationkey and fl.date = st.date)"""
EVENT_PANEL_SQL = f"""ed as (select user_id as cell, ts::date as date, sum(round(value * 100)::bigint)::bigint as v from events group by all),
ep as (select u.cell, s.date, ed.v from (select distinct user_id as cell from events) u
  cross join (select unnest(generate_series(date '{FIRST_DAY}', date '{LAST_DAY}', interval 1 day))::date as date) s left join ed on ed.cell = u.cell and ed.date = s.date)"""
