"""The streaming operators, run over files to their end; their results equal the batch form's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans import frames as P
from tessella.plans.registry import Registry
from tessella.session import shared_dir, table
from tessella.sources.upsert import VersionedTable
from tessella.streaming import windows as S
from tessella.streaming.timed import rocksdb, timed_decay

query = Registry()


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}*")


@query(
    "stream_tumbling_14d",
    "select o_orderpriority, date '2000-01-01' + floor((o_orderdate::date - date '2000-01-01') / 14.0)::int * 14 as date, count(*) as n, sum(round(o_totalprice * 100)::bigint)::bigint as total from orders group by 1, 2",
)
def stream_tumbling_14d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a stream into the panel's windows, upserted into a versioned table, of which a batch rewrites the years that it has."""
    orders = _stream(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderpriority", P.cents("o_totalprice").alias("v"))
    folder = f"{shared_dir(spark).rstrip('/')}/stream/{uuid.uuid4().hex}"
    out = VersionedTable(spark, f"{folder}/table", partition="year(date)")
    S.upsert_sink(S.tumbling_steps(orders, "ts", ["o_orderpriority"], "v", 14), out, ["o_orderpriority", "date"], f"{folder}/checkpoint").awaitTermination()
    return out.read()


@query(
    "batch_tumbling_right_closed",
    "select user_id, date '2000-01-01' + (floor((ts - interval 1 microsecond)::date - date '2000-01-01')::int // 14 + 1) * 14 as date, count(*) as n, sum(round(value * 100)::bigint)::bigint as total from events group by 1, 2",
)
def batch_tumbling_right_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), P.cents("value").alias("v"))
    return S.tumbling_steps(events, "ts", ["user_id"], "v", 14, right_closed=True)


@query(
    "stream_timed_decay",
    """with recursive d as (select event_type as cell, date_trunc('day', ts) as ts, sum(round(value * 100)::bigint)::double as x from events group by all),
    n as (select *, row_number() over (partition by cell order by ts) as i from d),
    y as (select cell, ts, i, x as decayed from n where i = 1 union all select n.cell, n.ts, n.i, 0.25::double * n.x + 0.75::double * y.decayed from n join y on n.cell = y.cell and n.i = y.i + 1)
    select cell, ts::date as date, round(decayed, 4) as decayed from y where ts <= (select max(ts) - interval 7 day from d)""",
)
def stream_timed_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily values of each kind of event, decayed in the order of time; days that the watermark hasn't passed wait."""
    events = _stream(spark, sf_dir, "events").select(F.col("event_type").alias("cell"), F.date_trunc("day", "ts").alias("ts"), P.cents("value").alias("v"))
    folder = f"{shared_dir(spark).rstrip('/')}/stream/{uuid.uuid4().hex}"
    schema = "cell string, ts timestamp, decayed double"
    with rocksdb(spark):
        S.run_to_end(timed_decay(events, "cell", "ts", "v", 0.25, 7, 60), lambda df, _: df.write.mode("append").parquet(f"{folder}/out"), f"{folder}/checkpoint")
    return spark.read.schema(schema).parquet(f"{folder}/out").select("cell", F.col("ts").cast("date").alias("date"), F.round("decayed", 4).alias("decayed"))


QUERIES, ORACLE_SQL = query.queries, query.oracle
