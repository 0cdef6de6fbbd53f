"""Folds of the order panel, and contributions of features to a model of the orders."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans import frames as P
from tessella.plans.model import attributions as A
from tessella.plans.model.ensemble import date_folds
from tessella.plans.registry import Registry
from tessella.session import table

query = Registry()
FEATURES = ["n_lines", "quantity", "discount", "parts", "month"]


@query("tree_attributions")
def tree_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's contributions of five features to its total price, as boosted trees see it; of orders without lines these are 0. Fitted trees have no SQL: tests hold the values against all subsets."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.count_distinct("l_partkey").alias("parts"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.month("o_orderdate").alias("month"))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").fillna(0, FEATURES))
    model = GBTRegressor(labelCol="o_totalprice", maxDepth=4, maxIter=5, seed=42).fit(rows)
    return A.long_contributions(A.contributions(model, rows, ["o_orderkey"]), ["o_orderkey"], FEATURES)


@query(
    "panel_folds",
    f"with {P.ORDER_PANEL_SQL}, f as (select date, ntile(5) over (order by date) - 1 as fold from (select distinct date from op)) select fold, count(*) as n, min(date) as first_date, max(date) as last_date, sum(v)::bigint as v from op join f using (date) group by fold",
)
def panel_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, dates and orders of each block of dates that out-of-fold predictions go by."""
    folds = date_folds(P.order_panel(spark, sf_dir), "date", 5)
    return folds.groupBy(F.col("_fold").alias("fold")).agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("v").alias("v"))


QUERIES, ORACLE_SQL = query.queries, query.oracle
