"""Timed state over shuffled micro-batches against the recursion on sorted rows."""

import datetime as dt
import random

from tessella.streaming import timed, windows

SCHEMA = "cell long, ts timestamp, v double"
DAY = dt.timedelta(days=1)
BEGIN = dt.datetime(2024, 1, 1)


def recursion(rows, alpha, idle_days):
    out, last = {}, {}
    sums = {}
    for cell, ts, v in rows:
        sums[cell, ts] = sums.get((cell, ts), 0.0) + (v or 0.0)
    for (cell, ts), x in sorted(sums.items()):
        y, at = last.get(cell, (None, None))
        y = x if y is None or ts - at > idle_days * DAY else alpha * x + (1 - alpha) * y
        last[cell] = (y, ts)
        out[cell, ts] = y
    return out


def run(spark, tmp_path, batches, late_days, idle_days):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    with timed.rocksdb(spark):
        decayed = timed.timed_decay(stream, "cell", "ts", "v", 0.5, late_days, idle_days)
        query = decayed.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).start()
        query.awaitTermination()
    return {(r["cell"], r["ts"]): r["decayed"] for r in spark.read.parquet(out).collect()}, query


def test_shuffled_batches_give_the_recursion_and_silent_cells_expire(spark, tmp_path):
    rng = random.Random(4)
    rows = [(cell, BEGIN + d * DAY, None if rng.random() < 0.2 else float(rng.randint(1, 9))) for cell in (1, 2) for d in range(12) if (cell, d) != (2, 5)]
    rows += [(1, BEGIN + 3 * DAY, 4.0), (1, BEGIN + 30 * DAY, 8.0), (3, BEGIN, 5.0)]  # a time twice; cell 1 after a silence; cell 3 but once
    shuffled = [r for r in sorted(rows, key=lambda r: (r[1] + rng.randint(0, 4) * DAY, rng.random()))]  # within the lateness
    size = -(-len(shuffled) // 3)
    batches = [shuffled[i : i + size] for i in range(0, len(shuffled), size)]
    batches.append([(9, BEGIN + 90 * DAY, 1.0)])  # moves the watermark past all others
    got, query = run(spark, tmp_path, batches, late_days=40, idle_days=10)
    want = recursion(rows, 0.5, 10)
    assert got == want and got[1, BEGIN + 30 * DAY] == 8.0
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert kept[-1] <= 4 < max(kept)  # what is left is the last row that waits and its timer


def test_setting_is_put_back(spark):
    before = spark.conf.get(timed.PROVIDER, None)
    with timed.rocksdb(spark):
        assert spark.conf.get(timed.PROVIDER) == timed.ROCKSDB
    assert spark.conf.get(timed.PROVIDER, None) == before
    assert windows.LATENESS
