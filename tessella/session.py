"""Session settings and intermediate tables that outlive a lost executor."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in local tests.
LOCAL_CHECKPOINTS = "/tmp/tessella-checkpoints"
#: A side of a join is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 100_000


def get_spark(cpus: int | str = "*", partitions: int = 8, app: str = "tessella") -> SparkSession:
    """A local session with the settings that the library expects; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # A panel that lies by cell stays so for joins on (cell, date): a cell has as many rows as any other.
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; without it, a local one in a local session only."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not re.fullmatch(r"local(\[.*\])?", master := spark.sparkContext.master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that the executors of {master} share")
    return LOCAL_CHECKPOINTS


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, and any executor can read it again.

    The tables go when the driver's process ends.
    """
    table, path = written(df)
    atexit.register(discard, df.sparkSession, path)
    return table


@contextmanager
def scratch(df: DataFrame) -> Iterator[DataFrame]:
    """As materialise, but the table goes at the end of the block: what was made of it must be written by then."""
    table, path = written(df)
    try:
        yield table
    finally:
        discard(df.sparkSession, path)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessella/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def compact(df: DataFrame) -> DataFrame:
    """df in at most two partitions a core, without a shuffle: for small results of many tasks, so that few files are written."""
    return df.coalesce(max(8, 2 * df.sparkSession.sparkContext.defaultParallelism))


def discard(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    hadoop_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows (it is counted, so pass a materialised table)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
