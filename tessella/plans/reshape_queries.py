"""Aggregation, reshaping, sets, top-k, scalar functions, text and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import ids, repair, text, vectors
from tessella.operators import aggregates as A
from tessella.operators import joins as J
from tessella.operators import ranking as R
from tessella.operators import similarity as S
from tessella.operators import spatial as X
from tessella.plans import frames as P
from tessella.plans.registry import Registry
from tessella.session import table

query = Registry()
KINDS = ["click", "error", "purchase", "signup", "view"]
_EV = "ev as (select user_id as cell, ts::date as date, event_type, round(value * 100)::bigint as v from events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), F.col("ts").cast("date").alias("date"), "event_type", P.cents("value").alias("v"))


@query("pivot_mean", "with " + _EV + " select cell, date, " + ", ".join(f"avg(case when event_type = '{k}' then v end) as \"{k}\"" for k in KINDS) + " from ev group by cell, date")
def pivot_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pivot(_events(spark, sf_dir), ["cell", "date"], "event_type", KINDS, "v")


@query("pivot_sum", "with " + _EV + " select cell, date, " + ", ".join(f"sum(case when event_type = '{k}' then v end)::bigint as \"{k}\"" for k in KINDS) + " from ev group by cell, date")
def pivot_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pivot(_events(spark, sf_dir), ["cell", "date"], "event_type", KINDS, "v", "sum")


@query("unpivot_nonzero", "with " + _EV + ", c as (select cell, date, count(*) filter (event_type = 'click') as clicks, count(*) filter (event_type = 'error') as errors from ev group by all) select * from (select cell, date, 'clicks' as variable, clicks as value from c union all select cell, date, 'errors', errors from c) x where value <> 0")
def unpivot_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _events(spark, sf_dir).groupBy("cell", "date").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return A.unpivot_nonzero(counts, ["cell", "date"], ["clicks", "errors"])


@query("multi_rule_agg", "select l_suppkey, year(l_shipdate)::int as year, sum(l_quantity)::double as l_quantity, max(l_extendedprice) as risk_price, avg(l_linenumber) as l_linenumber from lineitem group by 1, 2")
def multi_rule_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), "l_quantity", F.col("l_extendedprice").alias("risk_price"), "l_linenumber")
    return A.by_rule(lines, ["l_suppkey", "year"], A.rule_by_name(["l_quantity", "risk_price"]) | {"l_linenumber": "mean"})


@query("multi_key_sum", "select l_suppkey, case when l_linenumber > 5 then null else l_returnflag end as flag, sum(l_quantity)::double as q, count(*) as n from lineitem group by 1, 2")
def multi_key_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null keys stay a group."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_suppkey", F.when(F.col("l_linenumber") <= 5, F.col("l_returnflag")).alias("flag")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))


@query("ratio_zero_guard", "with x as (select l_partkey, sum(case when l_returnflag = 'R' then l_quantity else 0 end)::double as returned, count(case when l_linestatus = 'F' then 1 end) as filled, max(l_quantity) as peak from lineitem group by 1) select l_partkey, peak, returned / case when filled = 0 then 1 else filled end as ratio from x")
def ratio_zero_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("returned"), F.count_if(F.col("l_linestatus") == "F").alias("filled"), F.max("l_quantity").alias("peak"))
    return sums.select("l_partkey", "peak", A.guarded_ratio(F.col("returned"), F.col("filled")).alias("ratio"))


@query("distinct_and_conditional", "select l_suppkey, year(l_shipdate)::int as year, count(distinct l_partkey) as n_parts, sum((l_returnflag = 'R')::int)::bigint as n_returned, avg(l_quantity) as mean_quantity from lineitem group by 1, 2")
def distinct_and_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.count_distinct("l_partkey").alias("n_parts"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.avg("l_quantity").alias("mean_quantity"))


_GAPS = "g as (select l_orderkey, l_linenumber, case when l_linenumber % 3 <> 0 then l_quantity end as a, case when l_linenumber % 4 <> 0 then l_linenumber * 2.0::double end as b, case when l_linenumber % 2 = 0 then l_tax * 100 end as c from lineitem)"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(n % 3 != 0, F.col("l_quantity")).alias("a"), F.when(n % 4 != 0, n * F.lit(2.0)).alias("b"), F.when(n % 2 == 0, F.col("l_tax") * 100).alias("c"))


@query("row_mean_skip_null", f"with {_GAPS} select l_orderkey, l_linenumber, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a is not null)::int + (b is not null)::int + (c is not null)::int, 0), 9) as mean, round(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0), 9) as total from g")
def row_mean_skip_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(A.row_mean(["a", "b", "c"]), 9).alias("mean"), F.round(A.row_sum(["a", "b", "c"]), 9).alias("total"))


@query("weighted_row_sum", f"with {_GAPS} select l_orderkey, l_linenumber, round(coalesce(a, 0) * 0.3::double + coalesce(b, 0) * 0.25::double + coalesce(c, 0) * 0.45::double, 9) as score from g")
def weighted_row_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(A.weighted_sum({"a": 0.3, "b": 0.25, "c": 0.45}), 9).alias("score"))


@query("interaction_products", f"with {_GAPS} select l_orderkey, l_linenumber, coalesce(a, 0) * coalesce(b, 0) as ab, greatest(coalesce(a - 20, 0), 0) * coalesce(b, 0) as above from g")
def interaction_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).withColumn("a20", F.col("a") - 20).select("l_orderkey", "l_linenumber", A.interaction("a", "b").alias("ab"), A.positive_part("a20", "b").alias("above"))


@query("admin_coverage_agg", "with c as (select c_nationkey, case when c_custkey % 20 < c_nationkey then round(c_acctbal) end as v from customer) select c_nationkey, case when count(v) / count(*) >= 0.5 then avg(v) end as v, count(v) as n_values, count(*) as n_rows from c group by 1")
def admin_coverage_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 20 < F.col("c_nationkey"), F.round("c_acctbal")).alias("v"))
    return A.covered(customers, "c_nationkey", "v")


@query("admin_median_by_date", f"with {P.ORDER_EVENTS_SQL} select n_regionkey, date_trunc('month', d)::date as month, avg(v) as mean_v, sum(v)::bigint as sum_v, quantile_cont(v, 0.5) as median_v from oe join nation on n_nationkey = cell group by 1, 2")
def admin_median_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("cell"), "n_regionkey")
    return P.order_events(spark, sf_dir).join(regions, "cell").groupBy("n_regionkey", F.trunc("d", "month").alias("month")).agg(F.avg("v").alias("mean_v"), F.sum("v").alias("sum_v"), F.percentile("v", 0.5).alias("median_v"))


@query("two_level_minmax", f"with {P.ORDER_PANEL_SQL}, r as (select date, n_regionkey, sum(v)::bigint as v from op join nation on n_nationkey = cell group by all) select date, max(v) as max_v, min(v) as min_v, avg(v) as mean_v from r group by date")
def two_level_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("cell"), "n_regionkey")
    by_region = P.order_panel(spark, sf_dir).join(regions, "cell").groupBy("date", "n_regionkey").agg(F.sum("v").alias("v"))
    return by_region.groupBy("date").agg(F.max("v").alias("max_v"), F.min("v").alias("min_v"), F.avg("v").alias("mean_v"))


@query("audit_union", " union all ".join(f"select '{s}' as source, min({d}::date) as first_date, max({d}::date) as last_date, count(*) as n_rows, count(distinct {k}) as n_keys from {t}" for s, t, d, k in (("orders", "orders", "o_orderdate", "o_custkey"), ("lines", "lineitem", "l_shipdate", "l_suppkey"), ("events", "events", "ts", "user_id"))))
def audit_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.audit([("orders", table(spark, sf_dir, "orders"), "o_orderdate", "o_custkey"), ("lines", table(spark, sf_dir, "lineitem"), "l_shipdate", "l_suppkey"), ("events", table(spark, sf_dir, "events"), "ts", "user_id")])


@query("filtered_counts", "select l_returnflag, count(*) as n, count(*) filter (l_quantity > 25) as n_large, count(*) filter (l_discount is null) as n_missing, avg((l_linestatus = 'F')::int) as share_filled from lineitem group by 1")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("n_large"), F.count_if(F.col("l_discount").isNull()).alias("n_missing"), F.avg((F.col("l_linestatus") == "F").cast("int")).alias("share_filled"))


@query("null_rates", f"with {_GAPS} select 'a' as \"column\", avg((a is null)::int::double) as null_rate from g union all select 'b', avg((b is null)::int::double) from g union all select 'c', avg((c is null)::int::double) from g")
def null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.null_rates(_gaps(spark, sf_dir), ["a", "b", "c"])


@query("quantile_by_group", "select l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) as q90, round(quantile_cont(l_extendedprice, 0.5), 4) as q50, round(quantile_cont(l_extendedprice, 0.25), 4) as q25 from lineitem group by 1")
def quantile_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", [0.9, 0.5, 0.25]).alias("q")).select("l_returnflag", *[F.round(F.col("q")[i], 4).alias(name) for i, name in enumerate(("q90", "q50", "q25"))])


@query("actor_lethality", "with t as (select event_type || '_' || user_id % 20 as actor, sum(user_id % 7 - 1)::bigint as total from events group by 1 having sum(user_id % 7 - 1) > 0) select actor, total, round(ln(1 + total) / max(ln(1 + total)) over (), 9) as lethality from t")
def actor_lethality(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.concat(F.upper("event_type"), F.lit("_"), F.col("user_id") % 20, F.lit(" ")).alias("who"), (F.col("user_id") % 7 - 1).alias("dead"))
    return A.lethality(events, "who", "dead").withColumn("lethality", F.round("lethality", 9))


@query("latest_year_rows", f"with {P.ORDER_EVENTS_SQL} select cell, count(*) as n, sum(v)::bigint as v from oe where year(d) = (select max(year(d)) from oe) group by cell")
def latest_year_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = P.order_events(spark, sf_dir).withColumn("year", F.year("d"))
    return A.latest_year(events, "year").groupBy("cell").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


@query("zonal_stats", "select p_size::bigint as zone, avg(case when p_partkey % 5 <> 0 then p_partkey end) as zonal_mean, coalesce(sum(case when p_partkey % 5 <> 0 then p_partkey end), 0)::double as zonal_sum from part group by 1")
def zonal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("zone"), F.when(F.col("p_partkey") % 5 == 0, -9999.0).otherwise(F.col("p_partkey").cast("double")).alias("x"))
    return X.zonal(pixels, "zone", "x", -9999.0)


@query("latest_per_key", "select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, max(o_orderdate)::date as d from orders group by 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("d"), "o_orderkey")
    return R.newest(orders, ["o_custkey"], ["d", "o_orderkey"])


@query("dedup_first", "select o_custkey, o_orderpriority, min(o_orderkey) as o_orderkey, arg_min(o_orderstatus, o_orderkey) as o_orderstatus from orders group by all")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_by_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus"), ["o_custkey", "o_orderpriority"], ["o_orderkey"])


@query("top_n_desc", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def top_n_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_n(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100)


@query("top_percent", "with r as (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey)::int as rank, count(*) over (partition by c_nationkey) as n from customer) select c_nationkey, c_custkey, rank, rank <= 20 as is_top from r where rank <= ceil(n * 7.5 / 100)")
def top_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_percent(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", "c_acctbal", "c_custkey", 7.5).drop("c_acctbal")


@query("union_split_weights", f"with {P.ORDER_EVENTS_SQL} select o_orderkey, case when o_orderstatus = 'O' then part else o_orderstatus end as o_orderstatus, case when o_orderstatus = 'O' then v * w else v::double end as v from oe cross join (select 'north' as part, 0.612::double as w union all select 'south', 0.388::double) s where o_orderstatus = 'O' or part = 'north'")
def union_split_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = P.order_events(spark, sf_dir).select("o_orderkey", "o_orderstatus", "v")
    return R.split_weights(events, F.col("o_orderstatus") == "O", {"north": 0.612, "south": 0.388}, "o_orderstatus", "v")


@query("hash_sample", "select c_custkey, c_nationkey from customer where ('0x' || substr(md5('42:' || c_custkey::varchar), 1, 8))::bigint % 1000000 < 100000")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the customers, by hash: sampling is the feature here."""
    return R.hash_sample(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", 0.1)


_NAMES = "nm as (select p_partkey, ['Préfecture de ', 'Sous-Prefecture ', 'Prefecture de ', '', 'Prefecture De Prefecture '][(p_partkey % 5 + 1)::int] || p_name || ['', '-Ést', ' (II)', '  Ôuest Ñ'][(p_partkey % 4 + 1)::int] as name from part)"


@query(
    "norm_name",
    f"with {_NAMES}, t as (select p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '^prefecture de ', ''), '^prefecture ', ''), '^sous-prefecture de ', ''), '^sous-prefecture ', '') as n from nm) select p_partkey, trim(regexp_replace(translate(n, 'éèêëàâäôöûüçîï', 'eeeeaaaoouucii'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as name from t",
)
def norm_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.array(*map(F.lit, ("Préfecture de ", "Sous-Prefecture ", "Prefecture de ", "", "Prefecture De Prefecture ")))
    after = F.array(*map(F.lit, ("", "-Ést", " (II)", "  Ôuest Ñ")))
    k = F.col("p_partkey")
    name = F.concat(F.element_at(before, (k % 5 + 1).cast("int")), "p_name", F.element_at(after, (k % 4 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", text.normal_name(name).alias("name"))


@query("text_quality", r"""with t as (select doc_id, trim(coalesce(text, '')) as t from documents), n as (select *, case when t = '' then 0 else len(regexp_split_to_array(t, '[ \t\n\x0b\f\r]+')) end as n from t)
    select doc_id, (case when n < 5 then 0.1 when regexp_matches(t, '(?i)no additional information|as reported|according to sources|details are unclear|unconfirmed reports|no further details') then 0.3 else least(1.0, greatest(0.1, n / 30.0)) end)::double as weight from n""")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.quality_weight(F.col("text")).alias("weight"))


_RAW = "['[9.63E0]', 'nan', ' 12 ', 'abc', '[-3.5]', '', 'None', '1e3']"


@query("repair_numeric", f"with r as (select p_partkey, {_RAW}[(p_partkey % 8 + 1)::int] as t from part), c as (select p_partkey, lower(regexp_replace(t, '[\\[\\]\\s]', '', 'g')) as t from r) select p_partkey, case when t not in ('', 'nan', 'none', 'null', 'na', 'n/a') then try_cast(t as double) end as number from c")
def repair_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(*[F.lit(x) for x in ("[9.63E0]", "nan", " 12 ", "abc", "[-3.5]", "", "None", "1e3")])
    return table(spark, sf_dir, "part").select("p_partkey", repair.repaired_number(F.element_at(raw, (F.col("p_partkey") % 8 + 1).cast("int"))).alias("number"))


@query("year_expand", "select p_partkey, unnest(range(1990 + p_partkey % 10, 1990 + p_partkey % 10 + p_size % 6 + 1))::bigint as year from part")
def year_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.lit(1990) + F.col("p_partkey") % 10
    return repair.year_range(table(spark, sf_dir, "part").select("p_partkey", first.alias("a"), (first + F.col("p_size") % 6).alias("b")), "a", "b").select("p_partkey", F.col("year").cast("long").alias("year"))


@query("multi_value_explode", "with f as (select p_partkey, unnest(string_split('1#' || p_name || '#a#b#4.' || p_size || '#18;2#x;3#' || p_brand || '#c#d#5#19#z', ';')) as f from part), s as (select p_partkey, string_split(f, '#') as p from f) select p_partkey, p[1] as kind, p[2] as place, try_cast(p[5] as double) as lat from s where len(p) >= 6")
def multi_value_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.concat(F.lit("1#"), "p_name", F.lit("#a#b#4."), "p_size", F.lit("#18;2#x;3#"), "p_brand", F.lit("#c#d#5#19#z"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.explode(repair.multi_value(field)).alias("p"))
    return parts.select("p_partkey", F.col("p")[0].alias("kind"), F.col("p")[1].alias("place"), F.col("p")[4].try_cast("double").alias("lat"))


@query(
    "json_top_k",
    "with u as (select o_custkey, o_orderpriority as feature, sum((o_orderkey % 11) - 5)::bigint as value from orders group by all), r as (select *, row_number() over (partition by o_custkey order by abs(value) desc, feature) as k from u) select o_custkey, string_agg(feature || '=' || value, ';' order by k) as top from r where k <= 3 group by 1",
)
def json_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON and read back, as the prediction table keeps it."""
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("feature")).agg(F.sum(F.col("o_orderkey") % 11 - 5).alias("value"))
    items = sums.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("items"))
    stored = items.select("o_custkey", F.to_json("items").alias("json"))
    read = stored.select("o_custkey", F.from_json("json", "array<struct<feature:string,value:bigint>>").alias("items"))
    top = F.transform(R.top_absolute(F.col("items"), 3, "value"), lambda s: F.concat_ws("=", s["feature"], s["value"]))
    return read.select("o_custkey", F.array_join(top, ";").alias("top"))


@query(
    "h3_id_signed",
    "with i as (select event_id, (event_id * 1099511627 + 599686042433355775) as id from events) select event_id, case when event_id % 3 = 2 then id - 9223372036854775807 - 1 else id end::bigint as signed, lower(to_hex(case when event_id % 3 = 2 then id - 9223372036854775807 - 1 else id end::bigint)) as hex from i",
)
def h3_id_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexadecimal, decimal, and unsigned decimal beyond the range of a long (which folds), all to the same signed long."""
    i = F.col("event_id") * 1099511627 + F.lit(599686042433355775)
    unsigned = (i.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")
    written = F.when(F.col("event_id") % 3 == 0, F.hex(i)).when(F.col("event_id") % 3 == 1, i.cast("string")).otherwise(unsigned)
    df = table(spark, sf_dir, "events").select("event_id", ids.signed_id(written).alias("signed"))
    return df.withColumn("hex", ids.hex_text(F.col("signed")))


_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double)) / sqrt(list_sum(list_transform({a}, lambda z: z::double * z::double)) * list_sum(list_transform({b}, lambda z: z::double * z::double)))"


@query(
    "cosine_anchor_score",
    f"""with a as (select list(embedding order by vec_id) as v from embeddings where vec_id < 5),
    s as (select vec_id, {_COS.format(a='embedding', b='v[1]')} as p1, {_COS.format(a='embedding', b='v[2]')} as p2, {_COS.format(a='embedding', b='v[3]')} as p3, {_COS.format(a='embedding', b='v[4]')} as n1, {_COS.format(a='embedding', b='v[5]')} as n2 from embeddings cross join a)
    select vec_id, round(greatest(0, least(1, greatest(p1, p2, p3) - 0.5::double * greatest(n1, n2))), 9) as score, round(greatest(0, least(1, 1 - (list_sort([p1, p2, p3])[3] - list_sort([p1, p2, p3])[2]))), 9) as uncertainty from s""",
)
def cosine_anchor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five anchor vectors: three positive, two negative. The anchors are one broadcast row."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    anchors = e.where("vec_id < 5").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"]).alias("v"))
    cos = lambda i: vectors.cosine(F.col("embedding"), F.col("v")[i])
    df = e.crossJoin(F.broadcast(anchors)).select("vec_id", F.array(cos(0), cos(1), cos(2)).alias("p"), F.array(cos(3), cos(4)).alias("n"))
    return df.select("vec_id", F.round(vectors.anchor_score(F.col("p"), F.col("n")), 9).alias("score"), F.round(vectors.anchor_uncertainty(F.col("p")), 9).alias("uncertainty"))


@query(
    "centroid_velocity",
    f"""with p as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(x) as m from p group by all), c as (select label, list(m order by i) as c from m group by label), l as (select label, c, lag(c) over (order by label) as b from c)
    select label, round(case when b is not null then 1 - ({_COS.format(a='c', b='b')}) end, 9) as velocity from l""",
)
def centroid_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.centroid_velocity(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", F.round("velocity", 9).alias("velocity"))


@query(
    "report_split",
    "with e as (select conv_id, turn, role, text, sum((role = 'user')::int) over (partition by conv_id order by turn) as entry from conversations) select conv_id, entry::bigint as entry, max(case when role = 'user' then text end) as header, coalesce(string_agg(case when role <> 'user' then text end, ' ' order by turn), '') as body from e where entry > 0 group by conv_id, entry",
)
def report_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").withColumn("line", F.concat(F.when(F.col("role") == "user", "# ").otherwise(""), "text"))
    entries = text.split_entries(lines, "conv_id", "turn", "line", "^# ")
    return entries.select("conv_id", "entry", F.expr("substring(header, 3)").alias("header"), "body")


@query("token_filter", r"with w as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as w from documents) select doc_id, count(*) as n_tokens, count(distinct w) as n_distinct from w where length(w) >= 3 and w not in ('the', 'and', '') group by doc_id")
def token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.tokens(F.col("text"), ("the", "and"))).alias("w"))
    return tokens.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_distinct("w").alias("n_distinct"))


@query("keyword_commodity", "select p_partkey, case when regexp_matches(lower(n), 'maize') then 'maize' when regexp_matches(lower(n), 'rice') then 'rice' when regexp_matches(lower(n), 'oil') then 'oil' else 'other' end as commodity, case when starts_with(lower(p_type), 'standard') then 'plain' when starts_with(lower(p_type), 'pro') then 'raised' else 'other' end as theme from (select *, ['Yellow Maize ', 'RICE long ', 'Palm oil', 'salt'][(p_partkey % 4 + 1)::int] || p_name as n from part) x")
def keyword_commodity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.element_at(F.array(*map(F.lit, ("Yellow Maize ", "RICE long ", "Palm oil", "salt"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    rules = {k: text.COMMODITIES[k] for k in ("maize", "rice", "oil")}
    return table(spark, sf_dir, "part").select("p_partkey", text.keyword(F.concat(prefix, "p_name"), rules, "other").alias("commodity"), text.prefix_theme(F.col("p_type"), {"standard": "plain", "pro": "raised"}).alias("theme"))


@query("fuzzy_names", "select a.n_name as name, arg_min(b.n_name, (-(100 * (1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name), 1)::double)), b.n_name)) as nearest from nation a join nation b on a.n_nationkey <> b.n_nationkey group by 1")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gazetteer against itself: names of 25 nations, broadcast."""
    a = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("i"))
    pairs = a.join(F.broadcast(a.select(F.col("name").alias("other"), F.col("i").alias("j"))), F.col("i") != F.col("j"))
    return pairs.groupBy("name").agg(F.min_by("other", F.struct(-text.fuzzy_score(F.col("name"), F.col("other")), "other")).alias("nearest"))


@query("sparse_scores", "select o_orderpriority, o_orderstatus, case o_orderpriority when '1-URGENT' then 5 when '2-HIGH' then 4 when '3-MEDIUM' then 3 when '4-NOT SPECIFIED' then -1 else -2 end as score, count(*) as n from orders where o_orderstatus not in ('P') group by all")
def sparse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "4-NOT SPECIFIED": -1}.items() for x in kv]), F.col("o_orderpriority")), F.lit(-2))
    orders = table(spark, sf_dir, "orders").where(~F.col("o_orderstatus").isin("P"))
    return orders.groupBy("o_orderpriority", "o_orderstatus", score.alias("score")).agg(F.count("*").alias("n"))


# Invented names: the places are named after the parts; customers write them with up to three letters changed, dropped or put in.
_PLACES = "pl as (select p_partkey as place, substr(md5(p_partkey::varchar), 1, (12 + p_partkey % 9)::int) as place_name from part), np as (select count(*) as n from part)"
_WRITTEN = f"""{_PLACES}, wr as (select c_custkey, c_nationkey, place_name as p, length(place_name) as n, c_custkey % 6 as kind from customer join np on true join pl on place = c_custkey * 7 % np.n),
  nm as (select c_custkey, case kind when 0 then p when 1 then substr(p, 1, 4) || substr(p, 6) when 2 then 'x' || p when 3 then substr(p, 1, n - 3) || 'zz' || substr(p, n - 1)
    when 4 then 'nation ' || c_nationkey else 'y' || substr(p, 2, 5) || 'q' || substr(p, 8) || 'w' end as name from wr)"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), F.substring(F.md5(F.col("p_partkey").cast("string")), F.lit(1), (12 + F.col("p_partkey") % 9).cast("int")).alias("place_name"))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _places(spark, sf_dir)
    n = places.agg(F.count("*").alias("_all"))
    customers = table(spark, sf_dir, "customer").crossJoin(F.broadcast(n)).select("c_custkey", "c_nationkey", (F.col("c_custkey") * 7 % F.col("_all")).alias("place"))
    p, kind = F.col("place_name"), F.col("c_custkey") % 6
    cut = lambda a, b=1 << 30: F.substring(p, a if isinstance(a, Column) else F.lit(a), b if isinstance(b, Column) else F.lit(b))
    forms = [p, F.concat(cut(1, 4), cut(6)), F.concat(F.lit("x"), p), F.concat(cut(1, F.length(p) - 3), F.lit("zz"), cut(F.length(p) - 1)), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))]
    name = F.concat(F.lit("y"), cut(2, 5), F.lit("q"), cut(8), F.lit("w"))
    for i, form in enumerate(forms):
        name = F.when(kind == i, form).otherwise(name)
    return customers.join(places.hint("merge"), "place").select("c_custkey", name.alias("name"))


@query("similar_names", f"with {_WRITTEN} select distinct name, place_name as known, round(100 * (1 - levenshtein(name, place_name) / greatest(length(name), length(place_name))::double), 6) as score from nm, pl where 100 * (1 - levenshtein(name, place_name) / greatest(length(name), length(place_name))::double) >= 80")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.similar_names(_written(spark, sf_dir), _places(spark, sf_dir), 80, right_name="place_name")
    return found.select("name", F.col("place_name").alias("known"), F.round("score", 6).alias("score"))


@query(
    "resolve_entities",
    f"""with {_WRITTEN}, ex as (select name, min(place) as place from nm join pl on name = place_name group by name),
  sc as (select name, place_name, place, 100 * (1 - levenshtein(name, place_name) / greatest(length(name), length(place_name))::double) as s from (select distinct name from nm where name not in (select name from ex)) x, pl),
  fz as (select name, min(place) as place, max(s) as s from (select *, rank() over (partition by name order by s desc, place_name) as r from sc where s >= 90) y where r = 1 group by name)
select c_custkey, nm.name, coalesce(ex.place, fz.place, n_nationkey) as place, case when ex.place is not null then 'exact' when fz.place is not null then 'fuzzy' when n_nationkey is not null then 'nation' end as level,
  round(case when ex.place is not null then 100 else fz.s end, 6) as score from nm left join ex using (name) left join fz using (name) left join nation on nm.name = 'nation ' || n_nationkey""",
)
def resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' spellings to places: equal, else closest of 90 or more, else a nation."""
    units = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("unit_name"), F.col("n_nationkey").cast("long").alias("unit"))
    found = J.resolve_entities(_written(spark, sf_dir), "name", _places(spark, sf_dir), [("nation", units)])
    return found.select("c_custkey", "name", "place", "level", F.round("score", 6).alias("score"))


QUERIES, ORACLE_SQL = query.queries, query.oracle
