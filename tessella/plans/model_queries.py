"""Feature matrix, models, conformal intervals and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import windows as W
from tessella.operators.binning import value_bin
from tessella.plans import frames as P
from tessella.plans.model import conformal, diagnostics, ensemble, matrix, metrics
from tessella.plans.registry import Registry
from tessella.session import table

query = Registry()
# Scores of documents against their label, and of line items, made from their columns.
_SCORED = "sc as (select l.doc_id, l.toxic::int as y, ((d.n_chars * 7 + l.doc_id * 13 + l.toxic * 400) % 1000) / 1000.0::double as s from labels l join documents d using (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    s = (F.col("n_chars") * 7 + F.col("doc_id") * 13 + F.col("toxic") * 400) % 1000 / 1000.0
    return labels.join(docs, "doc_id").select("doc_id", F.col("toxic").alias("y"), s.alias("s"))


_POINTS = f"with {_SCORED}, c as (select s, sum(y)::bigint as p, sum(1 - y)::bigint as n from sc group by s), r as (select s as threshold, p, n, sum(p) over (order by s desc)::bigint as tp, sum(n) over (order by s desc)::bigint as fp, sum(p) over ()::bigint as all_p, sum(n) over ()::bigint as all_n from c), rp as (select *, tp / all_p as tpr, fp / all_n as fpr from r)"


@query("roc_points", f"{_POINTS} select threshold, tp, fp, tpr, fpr from rp")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_points(_scored(spark, sf_dir), "y", "s").select("threshold", "tp", "fp", "tpr", "fpr")


@query("metrics_auc", f"{_POINTS} select sum(p + n)::bigint as n, max(all_p) as positives, round(sum(n * (tp - p / 2.0::double) / (all_p * all_n)), 9) as roc_auc, round(sum(p / all_p * (tp / (tp + fp))), 9) as pr_auc from rp")
def metrics_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(_scored(spark, sf_dir), "y", "s").withColumns({c: F.round(c, 9) for c in ("roc_auc", "pr_auc")})


@query("best_threshold", f"{_POINTS} select arg_max(threshold, (tpr - fpr, threshold)) as threshold, max(tpr - fpr) as youden from rp")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_threshold(_scored(spark, sf_dir), "y", "s")


@query("recall_at_fpr", f"{_POINTS} select min(threshold) as threshold, arg_min(tpr, threshold) as recall, arg_min(tp / (tp + fp), threshold) as precision from rp where fpr <= 0.1")
def recall_at_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recall_at_fpr(_scored(spark, sf_dir), "y", "s")


@query("metrics_binary", f"with {_SCORED}, c as (select avg((s - y) ** 2) as brier, sum(y * (s >= 0.5)::int)::double as tp, sum((1 - y) * (s >= 0.5)::int)::double as fp, sum(y * (s < 0.5)::int)::double as fn, sum((1 - y) * (s < 0.5)::int)::double as tn from sc) select round(brier, 9) as brier, tp, fp, fn, tn, tp / (tp + fp) as precision, tp / (tp + fn) as recall, 2 * tp / (2 * tp + fp + fn) as f1, (tp + tn) / (tp + fp + fn + tn) as accuracy, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 9) as mcc from c")
def metrics_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.binary_summary(_scored(spark, sf_dir), "y", "s").withColumns({c: F.round(c, 9) for c in ("brier", "mcc")})


@query("recall_in_top", f"with {_SCORED}, r as (select *, row_number() over (order by s desc, doc_id) as i, floor(count(*) over () * 0.1)::bigint as k from sc) select max(k) as k, sum(case when i <= k then y else 0 end) / sum(y) as recall, sum(case when i <= k then y else 0 end) / sum(y) / 0.1::double as lift from r")
def recall_in_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recall_in_top(_scored(spark, sf_dir), "y", "s", "doc_id")


@query("tier_recall", f"with {_SCORED}, k as (select y, (rank() over (order by s desc) + (count(*) over (partition by s) - 1) / 2.0) / count(*) over () as share from sc), t as (select y, case when share <= 0.05 then '1_critical' when share <= 0.15 then '2_high' when share <= 0.3 then '3_elevated' else '4_baseline' end as tier from k), g as (select tier, count(*) as n, sum(y) as p from t group by tier) select tier, sum(n) over (order by tier)::bigint as n, sum(p) over (order by tier) / sum(p) over () as recall, sum(p) over (order by tier) / sum(n) over (order by tier) as precision from g")
def tier_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = W.average_percent_ranks(_scored(spark, sf_dir), "s", "share").withColumn("tier", W.tier(F.col("share")))
    return metrics.tier_recall(scored, "y", "tier", tuple(name for _, name in W.TIERS))


@query("yearly_auc", "with b as (select year(o_orderdate)::int as year, (o_orderstatus = 'F')::int as y, round(o_totalprice / 1000) as s from orders), c as (select year, s, sum(y)::bigint as p, sum(1 - y)::bigint as n from b group by all), r as (select *, sum(p) over (partition by year order by s desc) as tp, sum(p) over (partition by year) as all_p, sum(n) over (partition by year) as all_n from c) select year, sum(p + n)::bigint as n, max(all_p)::bigint as positives, round(sum(n * (tp - p / 2.0::double) / (all_p * all_n)), 9) as roc_auc from r group by year having sum(p + n) >= 10 and max(all_p) >= 2")
def yearly_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.round(F.col("o_totalprice") / 1000).alias("s"))
    return metrics.yearly_auc(rows, "y", "s", "year").drop("pr_auc").withColumn("roc_auc", F.round("roc_auc", 9))


_PREDICTED = "li as (select l_orderkey, l_linenumber, l_quantity as y, l_quantity + ((l_partkey * 7 + l_suppkey) % 21 - 10) / 2.0::double as m from lineitem)"
EDGES = [0.0, 5.0, 10.0, 20.0, 30.0, 40.0, 60.0]


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("l_quantity") + ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 21 - 10) / 2.0
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("y"), m.alias("m"))


_BIN = "case when {c} >= 60 then 6 when {c} >= 40 then 5 when {c} >= 30 then 4 when {c} >= 20 then 3 when {c} >= 10 then 2 when {c} >= 5 then 1 when {c} >= 0 then 0 end"
_QUANTILES = f"""{_PREDICTED}, er as (select {_BIN.format(c='y')} as bin, abs(y - m) as e from li), pl as (select *, row_number() over (partition by bin order by e) - 1 as i, count(*) over (partition by bin) as n, row_number() over (order by e) - 1 as gi, count(*) over () as gn from er),
bq as (select bin, max(n) as n, sum(greatest(0, 1 - abs(i - least(1.0::double, 0.9::double * (n + 1) / n) * (n - 1))) * e) as q from pl group by bin), gq as (select sum(greatest(0, 1 - abs(gi - least(1.0::double, 0.9::double * (gn + 1) / gn) * (gn - 1))) * e) as q from pl),
qs as (select b::int as bin, coalesce(bq.n, 0) as n, coalesce(bq.q, gq.q) as q from (select unnest(range(0, 7)) as b) x left join bq on bin = b cross join gq)"""


@query("quartile_bins", f"with {_PREDICTED}, v as (select l_orderkey, l_linenumber, m from li), e as (select quantile_cont(m, 0.25) as a, quantile_cont(m, 0.5) as b, quantile_cont(m, 0.75) as c from v where m > 0) select case when m >= c then 4 when m >= b then 3 when m >= a then 2 when m >= 1 then 1 when m >= 0 then 0 end as bin, count(*) as n, min(m) as low, max(m) as high from v, e group by 1")
def quartile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the bins at 0, 1, the quartiles of the values above 0 and infinity; below 0 none."""
    rows = _predicted(spark, sf_dir)
    edges = conformal.quartile_edges(rows, "m", log_scale=False)
    return rows.groupBy(value_bin(F.col("m"), edges).alias("bin")).agg(F.count("*").alias("n"), F.min("m").alias("low"), F.max("m").alias("high"))


@query("bccp_quantiles", f"with {_QUANTILES} select bin, n, round(q, 6) as q from qs")
def bccp_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformal.fit(_predicted(spark, sf_dir), "y", "m", EDGES).withColumn("q", F.round("q", 6))


@query("bccp_intervals", f"with {_QUANTILES} select l_orderkey, l_linenumber, round(greatest(0, m - q), 6) as lower, round(m + q, 6) as upper from li join qs on bin = coalesce({_BIN.format(c='m')}, 0)")
def bccp_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _predicted(spark, sf_dir)
    out = conformal.intervals(df, "m", conformal.fit(df, "y", "m", EDGES), EDGES, contiguous=False)
    return out.select("l_orderkey", "l_linenumber", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@query("coverage_by_bin", f"with {_QUANTILES}, w as (select max(round(q, 6)) as q from qs), i as (select y, greatest(0, m - q) as lower, m + q as upper from li cross join w) select {_BIN.format(c='y')} as bin, count(*) as n, avg((y between lower and upper)::int) as coverage, round(avg(upper - lower), 6) as mean_width, round(quantile_cont(upper - lower, 0.5), 6) as median_width from i group by 1")
def coverage_by_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _predicted(spark, sf_dir)
    q = conformal.fit(df, "y", "m", EDGES).withColumn("q", F.round("q", 6))
    covered = conformal.coverage(conformal.intervals(df, "m", q, EDGES), "y", EDGES)
    return covered.withColumns({c: F.round(c, 6) for c in ("mean_width", "median_width")})


@query("count_errors", f"with {_PREDICTED} select round(sqrt(avg((y - m) ** 2)), 9) as rmse, round(sqrt(avg(case when y > 0 then (y - m) ** 2 end)), 9) as rmse_positive, round(avg(case when y > 0 then abs(y - m) end), 9) as mae_positive, round(avg(2 * (case when y > 0 then y * ln(y / greatest(m, 1e-9)) else 0 end - (y - greatest(m, 1e-9)))), 6) as deviance from li")
def count_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.count_errors(_predicted(spark, sf_dir), "y", "m")
    return out.select(*[F.round(c, 9).alias(c) for c in ("rmse", "rmse_positive", "mae_positive")], F.round("deviance", 6).alias("deviance"))


@query("post_process", f"with {_PREDICTED}, b as (select l_orderkey, l_linenumber, least(500.0, greatest(0.0, exp(m / 10) - 1)) as predicted, least(1000.0, greatest(0.0, exp(m / 5) - 1)) as upper from li) select l_orderkey, l_linenumber, round(predicted, 6)::double as predicted, round(upper, 6)::double as risk_score from b")
def post_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _predicted(spark, sf_dir).select("l_orderkey", "l_linenumber", (F.col("m") / 10).alias("predicted"), F.lit(0.0).alias("lower"), (F.col("m") / 5).alias("upper"))
    return conformal.post_process(df).select("l_orderkey", "l_linenumber", F.round("predicted", 6).alias("predicted"), F.round("risk_score", 6).alias("risk_score"))


@query("onset_partition", f"""with {P.ORDER_PANEL_SQL}, w as (select v, lag(v) over (partition by cell order by date) as b, max(v) over (partition by cell order by date rows between 4 preceding and 1 preceding) as r from op)
    select case when v > 0 and coalesce(r, 0) = 0 then 'onset' when v > coalesce(b, 0) then 'escalation' else 'other' end as kind, count(*) as n, sum(v)::bigint as v from w group by 1""")
def onset_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.over_cell()
    df = P.order_panel(spark, sf_dir).withColumns({"b": F.lag("v").over(w), "r": F.max("v").over(w.rowsBetween(-4, -1))})
    return df.groupBy(metrics.onset_kind(F.col("v"), F.col("b"), F.col("r")).alias("kind")).agg(F.count("*").alias("n"), F.sum("v").alias("v"))


_RANK = "(rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double)"


@query("spearman_pairs", f"with r as (select {_RANK.format(c='l_quantity')} as a, {_RANK.format(c='l_discount')} as b, {_RANK.format(c='l_tax')} as c, {_RANK.format(c='l_linenumber')} as d from lineitem) select 'l_quantity' as a, 'l_discount' as b, round(corr(a, b), 6) as rho from r union all select 'l_quantity', 'l_tax', round(corr(a, c), 6) from r union all select 'l_quantity', 'l_linenumber', round(corr(a, d), 6) from r union all select 'l_discount', 'l_tax', round(corr(b, c), 6) from r union all select 'l_discount', 'l_linenumber', round(corr(b, d), 6) from r union all select 'l_tax', 'l_linenumber', round(corr(c, d), 6) from r")
def spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.spearman_pairs(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"]).withColumn("rho", F.round("rho", 6))


_VIF = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _determinant(columns: list[str]) -> str:
    """The determinant of the columns' moments, written out by its first row."""
    names = {frozenset((a, b)): f"{min(a, b)}__{max(a, b)}" for a in columns for b in columns}

    def minor(rows: list[str], cols: list[str]) -> str:
        if not rows:
            return "1"
        terms = (f"{'-' if i % 2 else '+'} {names[frozenset((rows[0], c))]} * ({minor(rows[1:], cols[:i] + cols[i + 1 :])})" for i, c in enumerate(cols))
        return f"0 {' '.join(terms)}"

    return minor(columns, columns)


@query(
    "vif_uncentred",
    f"with m as (select {', '.join(f'sum({a}::double * {b}) as {a}__{b}' for a in _VIF for b in _VIF if a <= b)} from lineitem) "
    + " union all ".join(f"select '{c}' as column, round({c}__{c} * ({_determinant([x for x in _VIF if x != c])}) / ({_determinant(_VIF)}), 4) as vif from m" for c in _VIF),
)
def vif_uncentred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.vif_uncentred(table(spark, sf_dir, "lineitem"), _VIF).withColumn("vif", F.round("vif", 4))


@query("linear_attribution", "with m as (select avg(l_quantity) as q, avg(l_linenumber) as n from lineitem), a as (select l_orderkey, l_linenumber, sum(0.5::double * (l_quantity - q)) as c1, sum(-2.0::double * (l_linenumber - n)) as c2 from lineitem cross join m group by 1, 2) select l_orderkey, l_linenumber, 'amount' as theme, round(c1, 6) as contribution from a union all select l_orderkey, l_linenumber, 'place', round(c2, 6) from a")
def linear_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q_amount"), F.col("l_linenumber").alias("n_place"))
    keys = ["l_orderkey", "l_linenumber"]
    long = diagnostics.linear_attributions(lines, {"q_amount": 0.5, "n_place": -2.0}, keys)
    return diagnostics.group_contributions(long, keys, {"Q_": "amount", "N_": "place"}).withColumn("contribution", F.round("contribution", 6))


@query("topic_impact", "select l_suppkey, count(*) as n, avg(l_quantity) as mean_prediction from lineitem group by 1 having count(*) > 5")
def topic_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.topic_impact(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity")


@query("importance_share", "with i as (select l_shipdate::date::varchar as feature, sum(l_quantity)::double as importance from lineitem group by 1) select sum(case when regexp_matches(feature, '^199[5-7]') then importance else 0 end) / sum(importance) as share, sum(case when regexp_matches(feature, '^199[5-7]') then importance else 0 end) / sum(importance) > 0.5 as alert from i")
def importance_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    importance = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").cast("string").alias("feature")).agg(F.sum("l_quantity").alias("importance"))
    return diagnostics.importance_share(importance, "^199[5-7]")


def _matrix(spark: SparkSession, sf_dir: str, require_targets: bool = True) -> DataFrame:
    panel = P.order_panel(spark, sf_dir).withColumn("v", F.col("v") / 1e7)
    w = W.over_cell()
    panel = panel.withColumns({"lag1": W.lag_zero("v", w), "mean6": W.rolling_mean("v", w, 6), "month_sin": F.round(F.sin(F.month("date").cast("double")), 6)})
    static = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("cell"), F.col("n_regionkey").cast("double").alias("region"))
    features = [matrix.Feature("lag1", "orders", "lag", "flow"), matrix.Feature("mean6", "orders", "rolling", "flow")]
    columns = matrix.resolve(features, {"season": ["month_sin"], "place": ["region"]}, panel.columns, static.columns)
    return matrix.build(panel, static, columns, "v", {"14d": 1, "1m": 2}, require_targets)


@query("feature_matrix", f"with {P.ORDER_PANEL_SQL}, x as (select cell, date, v / 1e7 as v from op), m as (select cell, date, coalesce(lag(v) over w, 0) as lag1, avg(v) over (w rows between 5 preceding and current row) as mean6, round(sin(month(date)::double), 6) as month_sin, v, lead(v, 1) over w as target_14d, lead(v, 2) over w as target_1m from x window w as (partition by cell order by date)) select cell, date, lag1, round(mean6, 9) as mean6, month_sin, v, target_14d, (target_14d > 0)::int as target_14d_binary, target_1m, (target_1m > 0)::int as target_1m_binary, n_regionkey::double as region from m join nation on n_nationkey = cell where target_1m is not null and target_14d is not null")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir).withColumn("mean6", F.round("mean6", 9))


@query("hurdle_ensemble")
def hurdle_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two themes, stacked over blocks of dates; scores every row of the matrix, those without targets too."""
    themes = [ensemble.Theme("activity", ("lag1", "mean6")), ensemble.Theme("setting", ("month_sin", "region"), None)]
    model = ensemble.fit(_matrix(spark, sf_dir), themes, "target_14d", "date")
    return model.predict(_matrix(spark, sf_dir, require_targets=False)).select("cell", "date", "prob", "mean_if_any", "expected")


QUERIES, ORACLE_SQL = query.queries, query.oracle
