import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.plans.model import ensemble


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    out = []
    for i in range(400):
        x, z = rng.normal(), rng.normal()
        p = 1 / (1 + np.exp(-2 * x))
        out.append((i, int(i // 20), float(x), float(z) if i % 9 else None, float(rng.poisson(3) + 1) if rng.random() < p else 0.0))
    return spark.createDataFrame(out, "id long, date int, x double, z double, y double")


def test_folds_are_blocks_of_dates(rows):
    got = {r["date"]: r["_fold"] for r in ensemble.date_folds(rows, "date", 4).select("date", "_fold").distinct().collect()}
    assert got == {d: d // 5 for d in range(20)}


def test_calibration_split_and_its_fallback(rows):
    data = rows.withColumn("any", (F.col("y") > 0).cast("double"))
    held = lambda **k: {r["id"] for r in ensemble.calibration_split(data, "any", ["date", "id"], **k).where("_calibrate").collect()}
    assert held() == set(range(320, 400))
    assert held(least=10_000) == set(range(280, 400))
    a, b = held(method="random"), held(method="random")
    assert a == b and len(a) == 80 and a != set(range(320, 400))
    with pytest.raises(ValueError):
        held(method="rolling")


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibrators(spark, method):
    rng = np.random.default_rng(1)
    s = rng.random(2000)
    df = spark.createDataFrame([(float(v), float(rng.random() < v**2)) for v in s], "s double, t double")
    got = ensemble.Calibrator(df, "s", "t", method).apply(df, "s").toPandas()
    assert got["s"].between(0, 1).all()
    assert ((got["s"] - s**2) ** 2).mean() < ((s - s**2) ** 2).mean() / 3
    order = np.argsort(s)
    assert (np.diff(got["s"].to_numpy()[order]) >= -1e-12).all()
    one = df.withColumn("t", F.lit(0.0))
    assert ensemble.Calibrator(one, "s", "t", method).apply(one, "s").select("s").exceptAll(one.select("s")).isEmpty()


def test_hurdle(rows):
    themes = [ensemble.Theme("a", ("x", "z")), ensemble.Theme("b", ("z",), None)]
    out = ensemble.fit(rows, themes, "y", "date", calibration="sigmoid").predict(rows).toPandas()
    assert len(out) == 400 and out["prob"].between(0, 1).all() and (out["expected"] - out["prob"] * out["mean_if_any"]).abs().max() < 1e-12
    up = out[out["y"] > 0]["prob"].mean()
    assert up > out[out["y"] == 0]["prob"].mean() + 0.15


def test_permutation_importance(rows):
    data = rows.fillna(0.0)
    metric = lambda df: -df.agg(F.avg(F.pow(F.col("x") - F.col("p"), 2))).first()[0]
    truth = data.select("id", F.col("x").alias("truth"))
    predict = lambda df: df.withColumn("p", F.col("x")).drop("x").join(truth, "id").withColumnRenamed("truth", "x")
    got = ensemble.permutation_importance(data, predict, metric, ["x", "z"], "id")
    assert got["x"] > 1 and abs(got["z"]) < 1e-9


def test_themes_from_settings():
    settings = {"submodels": {"a": {"features": ["x", "z", "x"]}, "off": {"enabled": False, "features": ["x"]}, "b": {"enabled": True, "features": ["z"], "variance": 0.9}}}
    assert ensemble.load_themes(settings) == [ensemble.Theme("a", ("x", "z"), None), ensemble.Theme("b", ("z",), 0.9)]
    assert ensemble.load_themes(settings, kept={"x"}) == [ensemble.Theme("a", ("x",), None)]
    assert ensemble.load_themes({}) == []
    with pytest.raises(ValueError):
        ensemble.load_themes({"submodels": {"a": {"features": []}}})


def test_boosted_meta_model_missing_inputs_and_explanations(rows):
    from tessella.plans.model import attributions

    themes = ensemble.load_themes({"submodels": {"a": {"features": ["x", "z"]}, "b": {"features": ["z"]}}})
    h = ensemble.fit(rows, themes, "y", "date", folds=2, meta="boosted", meta_params={"maxIter": 3})
    assert h.meta_class.__class__.__name__ == "GBTClassificationModel" and h.meta_class.getNumTrees == 3
    got = h.predict(rows.withColumn("a_note", F.lit(1))).toPandas()
    assert (got["a_note"] == 1).all() and got["prob"].between(0, 1).all() and got[got["y"] > 0]["prob"].mean() > got[got["y"] == 0]["prob"].mean() + 0.1
    lacking, zero = (h.predict(d).select("id", "expected").orderBy("id").collect() for d in (rows.drop("z"), rows.withColumn("z", F.lit(0.0))))
    assert lacking == zero
    themed = attributions.theme_contributions(h, rows, ["id"]).toPandas()
    model, x = h.classifiers["a"], h.prepared["a"].transform(rows)
    margin = x.select("id", attributions.vector_to_array("a_x").alias("v")).toPandas().set_index("id")["v"].map(lambda v: float(np.dot(v, model.coefficients.toArray())))
    summed = themed[themed["theme"] == "a"].groupby("id")["contribution"].sum()
    assert np.allclose(summed.sort_index(), margin.sort_index())
    weights = attributions.meta_weights(h)
    whole = attributions.explain(h, rows, ["id"]).toPandas()
    expected = themed.assign(c=themed["contribution"] * themed["theme"].map(weights)).groupby(["id", "feature"])["c"].sum()
    assert np.allclose(whole.set_index(["id", "feature"])["contribution"].sort_index(), expected.sort_index())
    with pytest.raises(ValueError):
        ensemble.fit(rows, themes, "y", "date", meta="other")
