"""Zipped tables in batch and as a stream."""

import datetime as dt
import random
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.sources import archives, readers

SCHEMA = "a long, day date, x double, who string, _archive string, _corrupt_record string"


@pytest.fixture
def source(spark):
    archives.register(spark)
    return lambda schema=SCHEMA: spark.read.format("zipped_tables").schema(schema).option("columns", "0,3,1,2")


def pack(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


GOOD = "1\t0.5\tü\t2024-01-02\textra\r\n\n2\t\t\t\n"


def test_types_blanks_and_bad_lines(source, tmp_path):
    bad = ["x\t1\tw\t2024-01-02", "3\t1\tw", "4\tno\tw\t2024-01-02", "5\t1\tw\t2024-13-02", f"{1 << 63}\t1\tw\t2024-01-02"]
    pack(tmp_path / "b.zip", {"m.csv": GOOD + "\n".join(bad), "folder/": "", "folder/n.csv": "6\t1\tz\t2024-01-03"})
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    pack(tmp_path / "cut.zip", {"m": "7\t1\tw\t2024-01-02\n"})
    data = bytearray((tmp_path / "cut.zip").read_bytes())
    data[16] ^= 255  # the check sum of the member
    at = data.index(b"PK\x01\x02") + 16
    data[at] ^= 255
    (tmp_path / "cut.zip").write_bytes(data)
    (tmp_path / "other.txt").write_text("1\t2\t3\t4")
    good = [(1, dt.date(2024, 1, 2), 0.5, "ü", "b.zip", None), (2, None, None, None, "b.zip", None), (6, dt.date(2024, 1, 3), 1.0, "z", "b.zip", None)]
    expected = good + [(None, None, None, None, "b.zip", line) for line in bad] + [(None, None, None, None, "broken.zip", "not an archive")]
    expected += [(None, None, None, None, "cut.zip", "m: Bad CRC-32 for file 'm'")]
    assert rows(source().load(str(tmp_path))) == sorted(expected, key=repr)
    assert source().load(str(tmp_path)).where("_corrupt_record is not null").count() == 7
    without = SCHEMA.replace(", _corrupt_record string", "")
    assert rows(source(without).load(str(tmp_path))) == sorted([g[:-1] for g in good], key=repr)
    with pytest.raises(Exception, match="bad line"):
        source().option("mode", "FAILFAST").load(str(tmp_path)).collect()


def test_columns_separators_and_one_archive(spark, tmp_path):
    pack(tmp_path / "x.zip", {"m": "1;2;3\n4;5\n7;8;9"})
    assert rows(readers.read_zipped_table(spark, str(tmp_path / "x.zip"), {2: "c", 0: "a"}, sep=";")) == [("3", "1"), ("9", "7")]
    with pytest.raises(Exception, match="columns for"):
        spark.read.format("zipped_tables").schema("a int").option("columns", "1,2").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="can't hold"):
        spark.read.format("zipped_tables").schema("a array<int>").load(str(tmp_path)).collect()
    assert spark.read.format("zipped_tables").schema("a string").load(str(tmp_path / "none")).count() == 0


def test_members_are_dealt_to_partitions(source, tmp_path):
    for i in range(5):
        pack(tmp_path / f"2024010{i}.zip", {f"m{j}": f"{i}{j}\t1\tw\t2024-01-02\n" * 10 for j in range(3)})
    df = source().option("bundleBytes", "250").load(str(tmp_path / "*.zip"))
    assert df.rdd.getNumPartitions() == 15 and df.count() == 150
    assert source().load(str(tmp_path / "*.zip")).rdd.getNumPartitions() == 1
    some = source().options(after="20240101.zip", upto="20240103.zip").load(str(tmp_path))
    assert {r[0] for r in some.select("_archive").distinct().collect()} == {"20240102.zip", "20240103.zip"}


def test_a_large_member_and_a_long_line_are_read_in_bounded_memory(tmp_path):
    line = "1\t0.5\t" + "w" * 80 + "\t2024-01-02\n"
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("m", "w", force_zip64=True) as m:
        for _ in range(60):
            m.write(line.encode() * 10_000)
        m.write(b"y" * (40 << 20) + b"\n" + line.encode())
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("_corrupt_record", T.StringType())])
    table = archives.Table(schema, {"path": str(tmp_path / "big.zip"), "maxlinebytes": "1000"})
    tracemalloc.start()
    n, corrupt = 0, []
    for b in table.read(archives.Bundle([(str(tmp_path / "big.zip"), "m")])):
        n += b.num_rows
        corrupt += [x for x in b["_corrupt_record"].to_pylist() if x is not None]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 600_002 and len(corrupt) == 1 and set(corrupt[0]) == {"y"} and most < 32 << 20


def test_stream_equals_batch_and_goes_on_where_it_stopped(spark, source, tmp_path):
    rng = random.Random(3)
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()

    def run():
        stream = spark.readStream.format("zipped_tables").schema(SCHEMA).option("columns", "0,3,1,2").load(str(folder))
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    for day in ("20240101", "20240102"):
        pack(folder / f"{day}.zip", {"m": "".join(f"{rng.randrange(100)}\t1\tw\t2024-01-02\n" for _ in range(30)) + "bad\n"})
    run()
    assert spark.read.parquet(out).count() == 62
    pack(folder / "20240103.zip", {"m": "9\t1\tw\t2024-01-02\n"})
    run()
    assert rows(spark.read.parquet(out)) == rows(source().load(str(folder)))
    assert spark.read.parquet(out).where(F.col("_archive") == "20240103.zip").count() == 1
