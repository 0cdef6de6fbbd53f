"""Streams over files give what the batch operators give."""

import datetime as dt

from pyspark.sql import functions as F

from tessella.operators import decay, windows
from tessella.sources.upsert import VersionedTable
from tessella.streaming import windows as S

VALUES = {1: [None, 5, None, None, None, 7, 7], 2: [3, None, 4, None, None, None, None]}


def write_batches(spark, folder):
    for i in range(7):
        rows = [(cell, dt.date(2024, 1, 6) + dt.timedelta(days=14 * i), None if vs[i] is None else float(vs[i])) for cell, vs in VALUES.items()]
        spark.createDataFrame(rows, "cell long, date date, v double").coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, make):
    folder = str(tmp_path / "in")
    write_batches(spark, folder)
    stream = spark.readStream.schema("cell long, date date, v double").parquet(folder)
    out = str(tmp_path / "out")
    S.run_to_end(make(stream), lambda df, _: df.write.mode("append").parquet(out), str(tmp_path / "check"))
    return spark.read.parquet(out), spark.read.parquet(folder)


def test_decay_states_equal_the_fold(spark, tmp_path):
    got, panel = run(spark, tmp_path, lambda s: S.decay_states(s, "cell", "date", "v", 0.5))
    want = decay.decay_fold(panel, "v", "decayed", 0.5).select("cell", "date", "decayed")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_fill_and_recency_equal_the_windows(spark, tmp_path):
    got, panel = run(spark, tmp_path, lambda s: S.fill_and_recency(s, "cell", "date", "v", 28))
    want = windows.recency(panel.withColumn("filled", windows.forward_fill("v", windows.over_cell(), 2)), "filled", "recency").select("cell", "date", "filled", F.col("recency").cast("double").alias("recency"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_upsert_sink_is_idempotent(spark, tmp_path):
    events = str(tmp_path / "events")
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 1.0) for i in range(30)]
    spark.createDataFrame(rows, "id long, ts timestamp, v double").write.parquet(events)
    t = VersionedTable(spark, str(tmp_path / "t"))
    for k in range(2):
        stream = spark.readStream.schema("id long, ts timestamp, v double").parquet(events)
        steps = S.tumbling_steps(S.deduplicated(stream, "id", "ts", 14).withColumn("cell", F.lit(1)), "ts", ["cell"], "v", None)
        S.upsert_sink(steps, t, ["cell", "date"], str(tmp_path / f"c{k}")).awaitTermination()
    got = sorted((r["date"], r["n"]) for r in t.read().collect())
    assert got == [(dt.date(2023, 12, 30), 12), (dt.date(2024, 1, 13), 14), (dt.date(2024, 1, 27), 4)]
