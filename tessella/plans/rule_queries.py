"""Rules of single families: news codes, kinds of columns, splits by date, truth by cell, attributes, damped scores, statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import columns, news, text
from tessella.operators import aggregates as A
from tessella.plans import features
from tessella.plans import frames as P
from tessella.plans.model import diagnostics, truth
from tessella.plans.registry import Registry
from tessella.session import table

query = Registry()


@query("news_codes", "select o_orderkey, case when substr((o_orderkey % 200)::varchar, 1, 2) in ('10', '11', '17', '18', '19') then case o_custkey % 6 when 3 then 1.0 when 4 then 1.0 when 5 then 0.5 when 1 then 0.25 else 0.75 end else 0.0 end::double as predatory from orders")
def news_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", news.predatory_count(F.col("o_orderkey") % 200, F.col("o_custkey") % 6).alias("predatory"))


_THEMES = ("MINING;ARMS", "REFUGEES;COUP", "MININGS", "FOOD_SECURITY", "EXTORTION;CORRUPTION;FAMINE", "")


@query("news_themes", "with t as (select p_partkey, ['MINING;ARMS', 'REFUGEES;COUP', 'MININGS', 'FOOD_SECURITY', 'EXTORTION;CORRUPTION;FAMINE', ''][(p_partkey % 6 + 1)::int] as t from part) select p_partkey, t in ('MINING;ARMS', 'EXTORTION;CORRUPTION;FAMINE') as resource_predation, t in ('REFUGEES;COUP', 'FOOD_SECURITY', 'EXTORTION;CORRUPTION;FAMINE') as displacement, t in ('REFUGEES;COUP', 'EXTORTION;CORRUPTION;FAMINE') as governance_breakdown from t")
def news_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    themes = F.element_at(F.array(*map(F.lit, _THEMES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", *[news.in_cluster(themes, c).alias(c) for c in news.THEME_CLUSTERS])


@query("column_kinds", "select * from (values ('target_1m', 'computed'), ('price_rice', 'sparse'), ('price_rice_lag1', 'sparse'), ('fatalities_14d', 'flow'), ('fatalities_decay_30d', 'computed'), ('event_count', 'flow'), ('ntl_mean', 'stock'), ('x_recency_days', 'sparse'), ('IODA_score', 'flow'), ('rain_lag1', 'stock')) t(name, kind)")
def column_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("target_1m", "price_rice", "price_rice_lag1", "fatalities_14d", "fatalities_decay_30d", "event_count", "ntl_mean", "x_recency_days", "IODA_score", "rain_lag1")
    return spark.createDataFrame([(n, columns.column_kind(n)) for n in names], "name string, kind string")


@query("time_splits", "with s as (select 'before' as convention, case when o_orderdate::date < date '1998-06-01' then 'train' else 'test' end as part, o_totalprice from orders union all select 'upto', case when o_orderdate::date <= date '1998-06-01' then 'train' else 'test' end, o_totalprice from orders union all select 'from', 'test', o_totalprice from orders where o_orderdate::date >= date '1998-06-01') select convention, part, count(*) as n, sum(round(o_totalprice * 100)::bigint)::bigint as v from s group by all")
def time_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderdate", P.cents("o_totalprice").alias("v"))
    parts = [truth.time_split(orders, "o_orderdate", "1998-06-01", c).withColumn("convention", F.lit(c)) for c in ("before", "upto", "from")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("convention", "part").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


_TRUTH = "tr as (select p.l_orderkey as cell, coalesce(case when p.l_linenumber % 5 = 0 then null else p.l_discount end, 0)::double as y_pred, coalesce(case when t.l_quantity > 40 then 1 when t.l_quantity > 30 then null else 0 end, 0)::double as y_true from lineitem p join lineitem t on p.l_orderkey = t.l_orderkey and p.l_linenumber = t.l_linenumber)"


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "cell")
    predicted = lines.select("cell", "l_linenumber", F.when(F.col("l_linenumber") % 5 != 0, F.col("l_discount")).alias("p"))
    targets = lines.select("cell", "l_linenumber", F.when(F.col("l_quantity") > 40, 1).when(F.col("l_quantity") > 30, None).otherwise(0).alias("y"))
    return truth.with_truth(predicted, targets, ["cell", "l_linenumber"], "p", "y")


@query("residuals_by_cell", f"with {_TRUTH} select cell, count(*) as n, round(avg(y_pred - y_true), 9) as residual from tr where y_true > 0 or y_pred > 0.05 group by cell")
def residuals_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.residuals_by_cell(_truth(spark, sf_dir), "cell").withColumn("residual", F.round("residual", 9))


@query("hits_by_cell", f"with {_TRUTH} select cell, count(*) filter (y_true > 0 and y_pred >= 0.05) as tp, count(*) filter (y_true > 0 and y_pred < 0.05) as fn, count(*) filter (y_true = 0 and y_pred >= 0.05) as fp from tr group by cell")
def hits_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.hits_by_cell(_truth(spark, sf_dir), "cell", 0.05)


@query("mean_with_attributes", "select o_custkey, o_orderdate::date as date, avg(round(o_totalprice * 100)::bigint) as v, min(o_orderpriority) as o_orderpriority, min(o_orderstatus) as o_orderstatus from orders group by 1, 2")
def mean_with_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("date"), P.cents("o_totalprice").alias("v"), "o_orderpriority", "o_orderstatus")
    return A.mean_with_attributes(rows, ["o_custkey", "date"], ["v"], ["o_orderpriority", "o_orderstatus"])


@query("site_attributes", "select l_suppkey, max(l_quantity) as largest, max((l_returnflag = 'R')::int) as returned, max(l_tax) as tax, count(*) as n, min(l_shipmode) as mode from (select *, l_returnflag || l_linestatus as l_shipmode from lineitem) x group by 1")
def site_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumns({"mode": F.concat("l_returnflag", "l_linestatus"), "returned": (F.col("l_returnflag") == "R").cast("int"), "one": F.lit(1).cast("long")})
    return A.multi_rule(lines, ["l_suppkey"], {"largest": ("max", "l_quantity"), "returned": ("max", "returned"), "tax": ("max", "l_tax"), "n": ("sum", "one"), "mode": ("first", "mode")})


@query("damped_scores", "select l_orderkey, round(sum(l_quantity), 9) as raw, round(sum(l_quantity) / sqrt(count(*)), 9) as damped from lineitem group by 1")
def damped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("raw"), F.count("*").alias("cells"))
    return by.select("l_orderkey", F.round("raw", 9).alias("raw"), F.round(A.damped("raw", "cells"), 9).alias("damped"))


@query("combined_risk", "select l_orderkey, l_linenumber, round(case when l_discount > 0 then l_quantity * (1 + l_discount) else l_quantity end, 9) as risk from lineitem")
def combined_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(A.weighted_if_known("l_quantity", "l_discount"), 9).alias("risk"))


_STATUS = ("MONOPOLY", "DOMINANT", "SENIOR PARTNER", "JUNIOR PARTNER", "POWERLESS", "DISCRIMINATED", "SELF-EXCLUSION", "IRRELEVANT")


@query(
    "ethnicity_by_year",
    f"""with {P.STEPS_SQL}, g as (select c_custkey, c_nationkey::bigint as cell, ['MONOPOLY', 'DOMINANT', 'SENIOR PARTNER', 'JUNIOR PARTNER', 'POWERLESS', 'DISCRIMINATED', 'SELF-EXCLUSION', 'IRRELEVANT'][(c_custkey % 8 + 1)::int] as status, (1994 + c_custkey % 5)::int as a, (1996 + c_custkey % 7)::int as b from customer),
    y as (select *, unnest(range(a, b + 1))::int as year from g where status <> 'IRRELEVANT'),
    s as (select cell, year, count(distinct c_custkey) as n, count(*) filter (status in ('DISCRIMINATED', 'POWERLESS')) as e, count(*) filter (status = 'DISCRIMINATED') as d, avg(case status when 'DOMINANT' then 4 when 'SENIOR PARTNER' then 3 when 'JUNIOR PARTNER' then 2 when 'POWERLESS' then 1 when 'DISCRIMINATED' then 0 when 'SELF-EXCLUSION' then 1 else -2 end) as m from y group by 1, 2)
    select n_nationkey::bigint as cell, st.date, coalesce(n, 0) as group_count, coalesce(e, 0) as excluded_count, coalesce(d, 0) as discriminated_count, round(coalesce(m, -2), 9) as status_mean from nation cross join st left join s on s.cell = n_nationkey and s.year = year(st.date)""",
)
def ethnicity_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    groups = customers.select(F.col("c_custkey").alias("group"), F.element_at(F.array(*map(F.lit, _STATUS)), (F.col("c_custkey") % 8 + 1).cast("int")).alias("status"), (1994 + F.col("c_custkey") % 5).cast("int").alias("first_year"), (1996 + F.col("c_custkey") % 7).cast("int").alias("last_year"))
    bridge = customers.select(F.col("c_custkey").alias("group"), F.col("c_nationkey").cast("long").alias("cell"))
    panel = P.spine(P.nations(spark, sf_dir), P.steps(spark, P.ANCHOR, P.END, P.DAYS))
    return features.ethnicity(panel, groups, bridge).withColumn("status_mean", F.round("status_mean", 9))


@query("clean_names", "select p_partkey, trim(regexp_replace(regexp_replace(lower(n), '[\"''`«»“”’]', '', 'g'), '\\s+', ' ', 'g')) as name from (select p_partkey, '  \"' || upper(p_name) || '’  «x» ' as n from part) x")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.clean(F.concat(F.lit('  "'), F.upper("p_name"), F.lit("’  «x» "))).alias("name"))


@query("moments", "select 'l_quantity' as a, 'l_tax' as b, round(sum(l_quantity * l_tax), 4) as s from lineitem union all select 'l_quantity', 'l_quantity', round(sum(l_quantity * l_quantity), 4) from lineitem union all select 'l_tax', 'l_tax', round(sum(l_tax * l_tax), 4) from lineitem")
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["l_quantity", "l_tax"]
    m = diagnostics.moments(table(spark, sf_dir, "lineitem"), names)
    return spark.createDataFrame([(names[i], names[j], round(float(m[i, j]), 4)) for i in range(2) for j in range(i, 2)], "a string, b string, s double")


QUERIES, ORACLE_SQL = query.queries, query.oracle
