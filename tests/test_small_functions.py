"""Small functions that no query calls."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import geo, ids, repair, text
from tessella.plans import contracts, serve
from tessella.sources import readers, upsert


def one(spark, column, value, kind):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, text.sentences, "Too short. This sentence is long enough! And so is this one, is it?  ", "string") == ["This sentence is long enough!", "And so is this one, is it?"]
    assert one(spark, text.sentences, None, "string") is None
    for name, want in (("ouham-pende", "ouham pende"), ("bangui", "bangui"), (None, None)):
        assert one(spark, lambda c: text.remap(c, {"ouham-pende": "ouham pende"}), name, "string") == want


def test_repair(spark):
    for array, want in (([4.0], 4.0), ([1.0, 2.0], 1.5), ([], None), (None, None)):
        assert one(spark, repair.scalar, array, "array<double>") == want
    for value, want in (("2", True), ("0", False), ("-1", False), ("x", False), (None, False)):
        assert one(spark, repair.positive_flag, value, "string") is want


def test_keys_and_boxes(spark):
    rows = [(dt.date(2024, 1, 2), "a" * 30, "place", 1), (dt.date(2024, 1, 2), "a" * 30, "place", 2)]
    keys = [r[0] for r in spark.createDataFrame(rows, "d date, a string, p string, n int").select(ids.synthetic_key(F.col("d"), F.col("a"), F.col("p"), F.col("n"))).collect()]
    assert all(k.startswith("20240102_" + "a" * 20 + "_place_") for k in keys) and len(set(keys)) == 2
    points = spark.createDataFrame([(2.0, 14.0), (11.0, 27.5), (1.9, 20.0), (5.0, 28.0), (None, 20.0)], "lat double, lon double")
    assert points.where(geo.in_box(F.col("lat"), F.col("lon"), 2, 11, 14, 27.5)).count() == 2


def test_archive_and_landed_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    folder = upsert.archive(df, str(tmp_path / "runs"), "run1", ("parquet", "csv"))
    assert folder == str(tmp_path / "runs" / "run1")
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/parquet").collect())) == [(1, "a"), (2, None)]
    assert spark.read.option("header", True).csv(f"{folder}/csv").count() == 2
    for i, page in enumerate(([{"id": 1, "n": 2.5}, {"id": 2}], [{"id": 3, "other": "x"}])):
        (tmp_path / f"page{i}.json").write_text(json.dumps(page, indent=1))
    landed = readers.read_landed_json(spark, str(tmp_path / "page*.json"), "id long, n double")
    assert sorted(map(tuple, landed.collect())) == [(1, 2.5), (2, None), (3, None)]
    (tmp_path / "settings.json").write_text('{"a": {"b": [1, 2]}}')
    assert readers.load_settings(str(tmp_path / "settings.json")) == {"a": {"b": [1, 2]}}


def test_static_features_and_column_lists(spark):
    static = spark.createDataFrame([(1, 0.5, [1]), (2, 0.7, [2])], "cell int, slope double, parts array<int>")
    assert [tuple(r) for r in serve.static_feature(static, "slope", 2).collect()] == [(2, 0.7)] and serve.static_feature(static, "slope").count() == 2
    with pytest.raises(ValueError):
        serve.static_feature(static, "slope; drop table x")
    assert serve.feature_list(static) == ["slope", "parts"] and contracts.non_scalar_columns(static) == ["parts"]
